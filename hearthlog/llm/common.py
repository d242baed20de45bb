"""Shared pieces of the training-data operators: materialising, text buffers, word hashes."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_count = itertools.count()
_written: list = []
_where: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. A local folder stands in where it is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="hearthlog-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/hearthlog/{uuid.uuid4().hex}/{next(_count)}-{name}"
    if not _written:
        atexit.register(_clean, spark)
    _written.append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _where[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that settle() wrote and nothing reads any more, before the process ends."""
    for df in tables:
        if path := _where.pop(df, None):
            _written.remove(path)
            _delete(df.sparkSession, path)


def settle_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str, schema: str) -> DataFrame:
    """The rows of all `parts` as one table: each is written before the next one is asked for."""
    path, none = _place(spark, name), spark.createDataFrame([], schema)
    none.write.parquet(path)
    for part in parts:
        part.select(*none.columns).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean(spark: SparkSession) -> None:
    try:
        for p in _written:
            _delete(spark, p)
    except Exception:  # the JVM has gone; the tables stay in the checkpoint folder
        pass


def arrow_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(col) -> "F.Column":
    return F.coalesce(col, F.lit("")).cast("binary")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column, end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about `most` bytes of text at a time (one long text at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


#: Values that one step of running() takes at a time, and code points that cut() walks over at most.
STRETCH, CHUNK = 512, 4096


def running(values: Column, zero: Column, add: Callable) -> Column:
    """For each place of an array what `add` makes of `zero` and the values before it.

    Appending to an array copies it, so stretches are summed first and then run through one by one: the work grows
    with the array (and, far slower, the square of the number of stretches). `values` should be a column at hand.
    """
    def scan(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("at"), F.array_repeat(start, 0).alias("out")), lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    part = lambda k: F.slice(values, k * STRETCH + 1, STRETCH)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int")), lambda k: F.aggregate(part(k), zero, add))
    found = F.flatten(F.transform(scan(sums, zero), lambda start, k: scan(part(k), start)))
    return F.when(F.size(values) > 0, found).otherwise(F.array_repeat(zero, 0))


def chunks(text: Column) -> Column:
    """A text in chunks of CHUNK code points, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in chunks, without walking there from the text's start."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    head = F.coalesce(F.get(pieces, i), F.lit(""))
    across = F.concat(F.substring(head, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(pieces, j), F.lit("")), F.lit(1), b % CHUNK))
    return F.when(i == j, F.substring(head, a % CHUNK + 1, b - a)).otherwise(across)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: The same with ASCII punctuation and control characters.
APART = _SPACE.copy()
APART[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 if k < 8 else 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes h in place."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0x9FB21C651E98DF25)
    h ^= h >> _U(32)
    return h


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end with their text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = off[:-1][off[:-1] < len(buf)]
    first[starts] = inside[starts]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range; A-Z count as a-z if lower."""
    data = np.concatenate([_LOWER[buf] if lower else buf, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    left = end - start
    h = left.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    live, at = None, start
    while len(at):
        part = view[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ part)
        else:
            h[live] = mix(h[live] ^ part)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, element by element."""
    h = np.full(len(columns[0]), 0x243F6A8885A308D3, np.uint64)
    for x in columns:
        h = mix(h * _U(0x9E3779B97F4A7C15) + x)
    return h
