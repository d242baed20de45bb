"""Vectors as blocks of whole numbers: the form in which the operators on embeddings read them.

A component x becomes floor(scale * x), x as double. With a scale that is a power of two the product is exact, so a
float64 holds every result exactly; a block keeps its numbers in the narrowest type that does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

#: Vectors a block holds at most.
ROWS = 2048
#: Whole numbers up to here are exact in float64, and so is every sum whose terms' absolute values add up to less.
EXACT, LONG = float(1 << 53), (1 << 63) - 1
SCHEMA = "n int, width int, kind string, data binary, ids binary, known binary, labels binary"


def usable(df: DataFrame, vector: str, size: int | None = None):
    """Condition: a vector that is there, with no component null or not finite (and `size` components, if given)."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    fine = x.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return fine & (F.size(x) == size) if size is not None else fine


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); what is beyond the largest double becomes the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(values * scale))


def pack(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in float64 as the narrowest type that holds them."""
    most = np.abs(values).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, values.astype(kind).tobytes()


def blocks(df: DataFrame, id_: str, vector: str, scale: int, width: int, label: str | None = None, rows: int = ROWS) -> DataFrame:
    """SCHEMA: up to `rows` vectors each; shorter vectors end in zeros. known: which ids are not null."""
    arrow_limits(df.sparkSession)
    x = df.select(F.col(id_).cast("long").alias("i"), F.transform(vector, lambda v: v.cast("double")).alias("v"), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("l"))

    def deal(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                p = b.slice(at, rows)
                v = p.column("v")
                off = np.asarray(v.offsets)
                flat, size = np.asarray(v.values)[off[0] : off[-1]], np.diff(off)
                m = np.zeros((len(size), width))
                row = np.repeat(np.arange(len(size)), size)
                m[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = quantised(flat, scale)
                kind, data = pack(m)
                ids = p.column("i")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({
                    "n": [len(size)], "width": [width], "kind": [kind], "data": [data], "ids": [ids.fill_null(LONG).to_numpy().astype("<i8").tobytes()],
                    "known": [known.astype("u1").tobytes()], "labels": [p.column("l").to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
                }, schema=_ARROW)

    return x.mapInArrow(deal, SCHEMA)


_ARROW = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("ids", pa.binary()), ("known", pa.binary()), ("labels", pa.binary())])


def matrix(block) -> np.ndarray:
    """The vectors of a block, as float64."""
    return np.frombuffer(block["data"], block["kind"]).reshape(block["n"], block["width"]).astype(np.float64)


def whole(values: np.ndarray) -> np.ndarray:
    """Python integers of any size."""
    out = np.empty(values.shape, object)
    out[...] = [[int(v) for v in row] for row in values] if values.ndim == 2 else [int(v) for v in values]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: in BLAS where all sums stay below 2^53, else in Python's integers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return a @ b.T
    return whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)))


def to_long(values: np.ndarray) -> np.ndarray:
    """As int64; what lies beyond becomes the nearest long."""
    if values.dtype != object:
        return values.astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, int(v))) for v in values.reshape(-1)], np.int64).reshape(values.shape)
