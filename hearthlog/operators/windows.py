"""Window operators: gaps, sessions, deltas, smoothing, contexts, stay points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grid_cell
from ..sources.store import stage


def _w(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def with_gap(df: DataFrame, key: str = "conversation", ts: str = "date", order: str = "ord") -> DataFrame:
    """Minutes since the message before."""
    before = F.lag(ts).over(_w([key], ts, order))
    return df.withColumn("gap_min", (F.unix_micros(ts) - F.unix_micros(before)) / 60e6)


def with_tempo(df: DataFrame, key: str = "conversation", ts: str = "date", order: str = "ord", last: int = 5) -> DataFrame:
    """Mean of the last gaps."""
    return df.withColumn("tempo_min", F.avg("gap_min").over(_w([key], ts, order).rowsBetween(1 - last, 0)))


def with_session(df: DataFrame, key: str = "conversation", ts: str = "date", order: str = "ord", threshold_min: float = 480, tempo_excludes_current: bool = False) -> DataFrame:
    """Running number of the session. The tempo rule counts where the tempo leaves the current gap out."""
    x = with_tempo(with_gap(df, key, ts, order), key, ts, order)
    if tempo_excludes_current:
        x = x.withColumn("tempo_min", F.avg("gap_min").over(_w([key], ts, order).rowsBetween(-5, -1)))
    new = F.col("gap_min").isNull() | ((F.col("gap_min") > 5 * F.col("tempo_min")) & (F.col("gap_min") > 15)) | (F.col("gap_min") > threshold_min)
    return x.withColumn("session", F.sum(new.cast("int")).over(_w([key], ts, order).rowsBetween(Window.unboundedPreceding, 0)))


def session_documents(df: DataFrame, key: str = "conversation", ts: str = "date", order: str = "ord", sender: str = "sender_name", text: str = "text", threshold_min: float = 480, max_msgs: int | None = None) -> DataFrame:
    """A document per session: its lines, up to two lines before it as context, first date, number of messages."""
    line = F.concat_ws(": ", sender, text)
    x = with_session(df.withColumn("line", line), key, ts, order, threshold_min)
    w = _w([key], ts, order)
    x = x.withColumns({"p1": F.lag("line", 1).over(w), "p2": F.lag("line", 2).over(w)})
    if max_msgs:
        n = F.row_number().over(_w([key, "session"], ts, order)) - 1
        x = x.withColumn("piece", (n / max_msgs).cast("int"))
    parts = [key, "session", *(["piece"] if max_msgs else [])]
    g = x.groupBy(*parts).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ts, order, "line"))), lambda s: s["line"]), "\n").alias("body"), F.min(ts).alias("date"), F.count("*").cast("int").alias("message_count"),
        F.min_by(F.array_compact(F.array("p2", "p1")), F.struct(ts, order)).alias("before"),
    )
    head = F.array_join(F.transform("before", lambda b: F.concat(F.lit("[CONTEXT] "), b)), "\n")
    return g.select(*parts, F.when(F.size("before") > 0, F.concat(head, F.lit("\n"), F.col("body"))).otherwise(F.col("body")).alias("text"), "date", "message_count")


def with_ordinal_id(df: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """Visible ids by position. The order is total over the table, so ranks are counted by range partitions:
    positions of ranges first, then within. The bounds of ranges are sampled, so the ranged rows are written once:
    counting and numbering read the same ranges."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    x = stage(df.repartitionByRange(int(parts), *order).withColumn("__p", F.spark_partition_id()), "ranges")
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    # one row a partition
    n = x.groupBy("__p").count().withColumn("__b", F.sum("count").over(Window.orderBy("__p")) - F.col("count")).select("__p", "__b")
    return x.join(F.broadcast(n), "__p").withColumn("id", F.concat(F.lit(prefix), (F.col("__b") + F.col("__i") - 1).cast("string"))).drop("__p", "__i", "__b")


def delta(c: str, key: str, *order) -> Column:
    """Change from the row before, 0 at the first."""
    return F.coalesce(F.col(c) - F.lag(c).over(_w([key], *order)), F.lit(0.0))


def smooth(c: str, key: str, width: int, *order) -> Column:
    """Centred sum divided by the width, as if zeros stood beyond the ends."""
    return F.sum(c).over(_w([key], *order).rowsBetween(-(width // 2), width - 1 - width // 2)) / width


def until_next(c: str, key: str, *order) -> Column:
    """W7."""
    return F.lead(c).over(_w([key], *order))


def context_text(c: str, key: str, n: int, *order) -> Column:
    """This text and up to n - 1 before it."""
    return F.array_join(F.collect_list(c).over(_w([key], *order).rowsBetween(1 - n, 0)), " [SEP] ")


def context_rows(cols: list[str], key: str, n: int, *order) -> Column:
    """The n rows before, as structs."""
    return F.collect_list(F.struct(*cols)).over(_w([key], *order).rowsBetween(-n, -1))


def stay_points(df: DataFrame, key: str, ts: str, lat: str, lng: str, gap_h: float = 3, least_s: int = 300, step: float = 0.01) -> DataFrame:
    """Runs of fixes in one grid cell without long gaps, of a least duration; coordinates of the first fix."""
    x = df.withColumn("cell", F.concat_ws("_", grid_cell(lat, step), grid_cell(lng, step)))
    w = _w([key], ts, lat, lng)
    new = F.coalesce((F.col("cell") != F.lag("cell").over(w)) | (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) > gap_h * 3600e6), F.lit(True))
    x = x.withColumn("stay", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy(key, "stay", "cell").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.min_by(lat, F.struct(ts, lat, lng)).alias("lat"), F.min_by(lng, F.struct(ts, lat, lng)).alias("lng"), F.count("*").alias("n"))
    return g.filter(F.unix_micros("end_time") - F.unix_micros("start_time") >= least_s * 1e6)
