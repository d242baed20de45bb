"""S3-S5 for large files: the objects of one JSON array, read by many tasks from byte ranges of the file.

Whether a byte lies inside a string, and how deep, depends on all bytes before it. A range can tell how it changes both
without knowing where it begins: the parity of its quotes, and the change in depth if it began outside and if it began
inside a string. Running sums of these over a file's ranges give each range's beginning; then every range is read once
more and yields the objects that begin in it, reading on past its end to finish the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import arrow_limits

#: Bytes of a range, and bytes read at a time beyond its end or before its beginning.
SPLIT, MORE = 8 << 20, 1 << 16
QUOTE, SLASH, OPEN, CLOSE = 34, 92, (91, 123), (93, 125)


@lru_cache
def _where(path: str):
    return pafs.FileSystem.from_uri(path)


def fetch(path: str, start: int, end: int) -> np.ndarray:
    """Bytes start to end of a file, in whatever store pyarrow can open."""
    system, name = _where(path)
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read_at(max(0, min(end, f.size()) - start), start), np.uint8)


def _escaped_before(path: str, start: int) -> bool:
    """Whether the byte at `start` follows an odd number of backslashes."""
    n, at = 0, start
    while at > 0:
        b = fetch(path, max(0, at - MORE), at)
        other = np.flatnonzero(b != SLASH)
        if len(other):
            return (n + len(b) - 1 - int(other[-1])) % 2 == 1
        n, at = n + len(b), at - len(b)
    return n % 2 == 1


def quotes(b: np.ndarray, escaped: bool) -> np.ndarray:
    """Positions of quotes that aren't escaped; escaped: the first byte is."""
    at = np.flatnonzero(b == QUOTE)
    slash = np.flatnonzero(b == SLASH)
    if not len(slash):
        return at[1:] if escaped and len(at) and at[0] == 0 else at
    new = np.append(True, np.diff(slash) > 1)
    begin = slash[new]  # runs of backslashes
    size = np.diff(np.append(np.flatnonzero(new), len(slash)))
    k = np.searchsorted(begin, at, "right") - 1
    run = np.where((k >= 0) & (begin[np.maximum(k, 0)] + size[np.maximum(k, 0)] == at), size[np.maximum(k, 0)] + (escaped & (begin[np.maximum(k, 0)] == 0)), 0)
    run = run + (escaped & (at == 0))
    return at[run % 2 == 0]


def depths(b: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, byte, change) of the brackets outside strings."""
    at = np.flatnonzero((b == 91) | (b == 123) | (b == 93) | (b == 125))
    within = (np.searchsorted(quotes(b, escaped), at) + inside) % 2 == 1
    at = at[~within]
    return at, b[at], np.where(np.isin(b[at], OPEN), 1, -1)


def objects(path: str, start: int, end: int, inside: bool, depth: int, level: int) -> Iterator[tuple[int, str]]:
    """(position, text) of the objects that begin between start and end, `level` brackets deep."""
    b = fetch(path, start, end)
    escaped = _escaped_before(path, start)
    at, kind, change = depths(b, inside, escaped)
    after = depth + np.cumsum(change)
    begin = at[(kind == 123) & (after == level + 1)]
    stop = at[(kind == 125) & (after == level)]
    last = None
    for x in begin.tolist():
        k = np.searchsorted(stop, x)
        if k == len(stop):
            last = x
            break
        yield start + x, b[x : stop[k] + 1].tobytes().decode("utf-8", "replace")
    if last is None:
        return
    parts, open_, inside, to = [b[last:]], None, False, start + len(b)
    piece, escaped = b[last:], False
    deep = 0
    while True:
        at, _, change = depths(piece, inside, escaped)
        level_ = deep + np.cumsum(change)
        closed = np.flatnonzero(level_ == 0)
        if len(closed):
            parts[-1] = piece[: at[closed[0]] + 1]
            yield start + last, np.concatenate(parts).tobytes().decode("utf-8", "replace")
            return
        deep = int(level_[-1]) if len(level_) else deep
        inside = (len(quotes(piece, escaped)) + inside) % 2 == 1
        piece = fetch(path, to, to + MORE)
        if not len(piece):  # the file ends inside an object
            return
        escaped = _escaped_before(path, to)
        parts.append(piece)
        to += len(piece)


def json_objects(spark: SparkSession, path: str, split: int = SPLIT, pattern: str = "*.json") -> DataFrame:
    """(path, at, value): the objects of each file's array, or of the arrays under a file's one object.

    A file that ends inside an object loses that one; other values in the array are passed over; empty files give no row."""
    arrow_limits(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = files.filter("length > 0").select("path", "length", each.alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split, F.col("length"))).repartition(parts, "path", "start")

    def scan(frames):
        for f in frames:
            out = []
            for p, a, z in zip(f["path"], f["start"], f["end"]):
                b, escaped = fetch(p, a, z), _escaped_before(p, a)
                parity = len(quotes(b, escaped)) % 2
                first = b[~np.isin(b, (32, 9, 10, 13, 0xEF, 0xBB, 0xBF))][:1]
                out.append((p, a, z, parity, *(int(depths(b, bool(i), escaped)[2].sum()) for i in (0, 1)), int(first[0]) if a == 0 and len(first) else None))
            yield pd.DataFrame(out, columns=["path", "start", "end", "parity", "d0", "d1", "first"]).astype({"first": "Int64"})

    seen = ranges.mapInPandas(scan, "path string, start long, end long, parity long, d0 long, d1 long, first long")
    w = Window.partitionBy("path").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    seen = seen.withColumn("change", F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0")))
    seen = seen.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    seen = seen.withColumn("level", F.when(F.first("first").over(w) == 123, 2).otherwise(1)).repartition(parts, "path", "start")

    def cut(frames):
        for f in frames:
            for p, a, z, inside, depth, level in zip(f["path"], f["start"], f["end"], f["inside"], f["depth"], f["level"]):
                rows, size = [], 0
                for at, value in objects(p, int(a), int(z), bool(inside), int(depth), int(level)):
                    rows.append((p, at, value))
                    size += len(value)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=["path", "at", "value"])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "at", "value"])

    return seen.select("path", "start", "end", "inside", "depth", "level").mapInPandas(cut, "path string, at long, value string")


def rows_of(spark: SparkSession, path: str, schema: str, split: int = SPLIT, **options) -> DataFrame:
    """The typed rows of large array files; objects of other shapes become rows of nulls, as Spark's own reader has them."""
    return json_objects(spark, path, split, **options).select(F.from_json("value", schema).alias("r")).select("r.*")


def write_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: each partition as a file that holds one array, an object a line; null fields are left out."""
    arrow_limits(df.sparkSession)

    def lines(frames):
        some = False
        for f in frames:
            if len(f):
                text = (",\n" if some else "[\n") + ",\n".join(f["value"])
                some = True
                yield pd.DataFrame({"value": [text]})
        if some:
            yield pd.DataFrame({"value": ["]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(lines, "value string").write.mode(mode).text(path)
