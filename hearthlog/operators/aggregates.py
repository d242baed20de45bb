"""Aggregations: counts, shares, histograms, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import message_type, strip
from ..values import EMOTIONS

LENGTHS = [(1, 1, "1"), (2, 2, "2"), (3, 5, "3-5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, 100, "51-100"), (101, None, "101+")]
#: Export artefacts and link previews, in English whatever the conversation's language.
ARTEFACT_STARTS = r"(?i)^(?:Download file:|magnet:\?|Liked a message)"


def most_frequent(df: DataFrame, key: str, order: str) -> DataFrame:
    """The most frequent value; of ties the one seen first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first", key).limit(1)


def counts_with_zeros(df: DataFrame, key: str, registry: DataFrame) -> DataFrame:
    """Counts of every value of a registry."""
    c = df.groupBy(key).agg(F.count("*").alias("n"))
    return registry.join(c, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def share(df: DataFrame, n: str = "n", out: str = "pct", digits: int = 1) -> DataFrame:
    """Percent of the total."""
    total = df.agg(F.sum(n).alias("__t"))  # one row
    return df.join(F.broadcast(total)).withColumn(out, F.when(F.col("__t") > 0, F.bround(F.col(n) / F.col("__t") * 100, digits)).otherwise(0.0)).drop("__t")


def year_timeline(df: DataFrame, date: str) -> DataFrame:
    """A3: rows by year, as percent of the fullest."""
    y = df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))
    most = y.agg(F.max("n").alias("m"))  # one row
    return y.join(F.broadcast(most)).select("year", "n", F.bround(F.col("n") / F.col("m") * 100, 1).alias("bar"))


def length_buckets(df: DataFrame, key: str, text: str) -> DataFrame:
    """A4: groups by their number of non-empty texts, in eight fixed buckets, empty ones too."""
    c = df.filter(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(key).agg(F.count("*").alias("c"))
    b = F.lit(None)
    for i, (lo, hi, _) in reversed(list(enumerate(LENGTHS))):
        b = F.when((F.col("c") >= lo) & ((F.col("c") <= hi) if hi else F.lit(True)), i).otherwise(b)
    names = df.sparkSession.createDataFrame([(i, x) for i, (_, _, x) in enumerate(LENGTHS)], "b int, bucket string")
    return counts_with_zeros(c.withColumn("b", b), "b", names).select("bucket", "n")


def active(counts: DataFrame) -> DataFrame:
    """A5."""
    return counts.agg(F.sum(((F.col("documents") > 0) | (F.col("nodes") > 0)).cast("int")).alias("active"))


def play_summary(plays: DataFrame) -> DataFrame:
    """A10."""
    ok = valid_play()
    return plays.agg(F.count_if(ok).alias("plays"), F.countDistinct(F.when(ok, F.struct("artist", "title"))).alias("tracks"), F.countDistinct(F.when(ok, F.col("artist"))).alias("artists"), F.bround(F.sum(F.when(ok, F.col("ms_played"))) / 3.6e6, 1).alias("hours"), F.count_if(~ok).alias("skipped"))


def valid_play() -> Column:
    """F11."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return ~blank("artist") & ~blank("title") & F.col("ts").isNotNull() & (F.coalesce("ms_played", F.lit(0)) > 30000)


def valid_fix() -> Column:
    """F12."""
    return (F.col("lat") != 0) & (F.col("lng") != 0) & F.col("ts").isNotNull()


def sane_gps() -> Column:
    """F14."""
    return (F.abs("lat") > 0.1) & (F.abs("lng") > 0.1) & ~F.startswith(F.coalesce("address", F.lit("")), F.lit("lat"))


def session_summary(sessions: DataFrame, key: str) -> DataFrame:
    """Per key and, with a null key, over all: time, number, first and last."""
    return sessions.rollup(key).agg(F.sum("duration_s").alias("total_s"), F.count("*").alias("sessions"), F.min("start_at").alias("first"), F.max("end_at").alias("last"), F.bround(F.sum("duration_s") / 3600, 1).alias("hours"))


def language_vote(df: DataFrame, key: str, text: str, is_french: Column, keep: int = 30, least: int = 30) -> DataFrame:
    """Per conversation the language of most of its longest texts; ties and none: en.

    System notices, reactions and artefacts of exports don't vote; of the others links and runs of white space are
    removed first, and length, rank and is_french (over the column text) are those of what is left.
    """
    from .joins import top_per

    said = df.filter((message_type(text) == "text") & ~F.col(text).rlike(ARTEFACT_STARTS))
    said = said.withColumn(text, F.regexp_replace(strip(F.regexp_replace(text, r"(?i)https?://\S+", "")), r"\s{2,}", " "))
    x = top_per(said.filter(F.length(text) >= least).withColumn("__n", F.length(text)), [key], keep, F.desc("__n"), text)
    v = x.groupBy(key).agg(F.count_if(is_french).alias("fr"), F.count_if(~is_french).alias("en"))
    return df.select(key).distinct().join(v, key, "left").select(key, F.when(F.coalesce("fr", F.lit(0)) > F.coalesce("en", F.lit(0)), "fr").otherwise("en").alias("language"))


def conversation_text(df: DataFrame, key: str, date: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """A14."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(date, order, text))), lambda s: s[text]), sep).alias("text"), F.count("*").alias("n"), F.min(date).alias("first_date"))


def evidence(df: DataFrame, key: str, date: str) -> DataFrame:
    """Keys seen twice, or in two years."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(F.year(date)).alias("years"), F.min(date).alias("since"), F.max(date).alias("last")).filter("n >= 2 or years >= 2")


def mentions(df: DataFrame, keys: list[str]) -> DataFrame:
    """A16."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n >= 2").withColumn("confidence", F.least(0.2 + F.col("n") / 10, F.lit(0.8)))


def population(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Population statistics of columns."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.var_pop(c).alias(f"{c}_var"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal bins, closed on the right, the first holds the minimum; empty bins too."""
    v = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    b = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) - 1))).cast("int")
    c = v.join(F.broadcast(b)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(b))
    return all_.join(c, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"))


def emotion_counts(df: DataFrame, dominant: str) -> DataFrame:
    return counts_with_zeros(df, dominant, df.sparkSession.createDataFrame([(e,) for e in EMOTIONS], f"{dominant} string"))


def drift(df: DataFrame, speaker: str, deltas: list[str]) -> DataFrame:
    """Movement of each speaker with two messages or more."""
    step = F.sqrt(sum((F.col(c) * F.col(c) for c in deltas), F.lit(0.0)))
    return df.withColumn("__d", step).groupBy(speaker).agg(F.count("*").alias("n"), F.bround(F.avg("__d"), 3).alias("mean_step"), F.bround(F.max("__d"), 3).alias("max_step"), F.bround(F.sum("__d"), 2).alias("path"), F.bround(F.stddev_pop("__d"), 3).alias("sigma")).filter("n >= 2")


def files_by_folder(files: DataFrame) -> DataFrame:
    """Files of each folder and of all folders below it."""
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.select(F.explode(up).alias("folder"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("own")).groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("own") == F.col("folder")).alias("own_files"))


def training_steps(examples: int, batch: int, accumulate: int, epochs: int, warmup: float) -> tuple[int, int]:
    """A33."""
    steps = max(1, examples // (batch * accumulate) * epochs)
    return steps, max(1, int(steps * warmup))
