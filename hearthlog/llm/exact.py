"""Exact duplicates by polynomial fingerprints that are put together from those of a text's pieces.

The fingerprint of bytes A + B is that of A, shifted by the length of B, plus that of B: as words w0, w1, ... of four
bytes it is the sum of w_i * base^(words after it) modulo 2^61 - 1, for two bases. So a piece's share can be computed
anywhere and in any order; its shift needs only the length of what follows.

1. Spark cuts texts of any length into pieces of PIECE bytes, one row each; a task hashes many pieces at once and
   shifts each by what follows it. Texts of one piece are done; the shares of the others are added up by text.
2. Rows are counted by (length, fingerprint), with their largest id; counts are pre-aggregated, no text is moved.
3. Fingerprints only nominate. Texts whose fingerprint is there more than once are read again as pieces; per
   fingerprint and place the least and the greatest piece are kept, first in each task, so that a class of any number
   of copies sends a few pieces a task. Where both are the same bytes everywhere, the class is one text.
4. Classes with different texts (equal fingerprints by chance) are split by their bytes.

Defined cases: null text is empty, and empty texts are copies of each other; a null id comes before all others; of
several rows with the largest id one stays; repeated rows are copies; texts of any length are whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, pieces, settle, text_bytes

#: Bytes of a piece; a multiple of four.
PIECE = 1 << 16
#: Classes of copies that are sent to all tasks; more than these are joined by a shuffle.
BROADCAST = 1 << 20
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)
KEY = ["n", "f1", "f2"]
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x = x * base % PRIME
    return np.array(out, np.uint64)


_POWERS: dict = {}


def powers(n: int) -> list[np.ndarray]:
    """base^0 to base^(n - 1) of both bases, computed once a process."""
    if len(_POWERS.get(0, ())) < n:
        _POWERS.update({k: _powers(b, n) for k, b in enumerate(BASES)})
    return [_POWERS[0], _POWERS[1]]


def _high(x: np.ndarray) -> np.ndarray:
    """x * 2^32 modulo PRIME, below 2^62, for x below 2^61."""
    return ((x & _U((1 << 29) - 1)) << _U(32)) + (x >> _U(29))


def piece_prints(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Fingerprints of byte ranges, one array a base; the last word of each ends in zeros."""
    size = np.diff(off)
    n = -(-size // 4)
    row = np.repeat(np.arange(len(n)), n)
    back = np.repeat(np.cumsum(n), n) - np.arange(len(row)) - 1  # words after it
    data = np.concatenate([buf, np.zeros(4, np.uint8)])
    view = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    w = view[off[:-1][row] + 4 * (n[row] - 1 - back)].astype(np.uint64)
    cut = np.flatnonzero(size % 4)
    w[np.cumsum(n)[cut] - 1] &= (_U(1) << (_U(8) * (size[cut] % 4).astype(np.uint64))) - _U(1)
    some, out = np.flatnonzero(n), []
    begin = (np.cumsum(n) - n)[some]
    for power in powers(int(n.max(initial=0)) or 1):
        p = power[back]
        low = w * (p & _U(0xFFFFFFFF))
        t = _high(w * (p >> _U(32))) + (low & _U(PRIME)) + (low >> _U(61))
        h = np.zeros(len(n), np.uint64)
        if len(some):
            high = np.add.reduceat(t >> _U(32), begin)
            h[some] = (_high(high) + np.add.reduceat(t & _U(0xFFFFFFFF), begin)) % _U(PRIME)
        out.append(h)
    return out


def shifted(h: int, base: int, after: int) -> int:
    """The share of a piece in its text's fingerprint, `after` bytes (whole words, or up to the text's end) before that ends."""
    return h * pow(base, -(-after // 4), PRIME) % PRIME


def cut_up(t: Column) -> Column:
    """Bytes in pieces; empty ones are one empty piece."""
    n = F.greatest(F.ceil(F.octet_length(t) / PIECE), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * PIECE + 1, F.lit(PIECE)))


def fingerprints(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(row, id, sha, n, f1, f2) of every row, as a table; row: a number of its own."""
    arrow_limits(df.sparkSession)
    x = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"), text_bytes(F.col(text)).alias("t"))
    x = x.select("row", "id", F.sha2("t", 256).alias("sha"), F.octet_length("t").cast("long").alias("n"), F.posexplode(cut_up(F.col("t"))).alias("no", "piece"))

    def hashed(batches):
        for b in batches:
            for p in pieces(b, "piece", 2 << 20):
                h = piece_prints(*buffers(p.column("piece")))
                n, no = (p.column(c).to_numpy().astype(np.int64) for c in ("n", "no"))
                after = np.maximum(0, n - (no + 1) * PIECE)
                for k in np.flatnonzero(after):
                    for j, base in enumerate(BASES):
                        h[j][k] = shifted(int(h[j][k]), base, int(after[k]))
                keep = [p.column(c) for c in ("row", "id", "sha", "n")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(n <= PIECE), *(pa.array(v.astype(np.int64)) for v in h)], ["row", "id", "sha", "n", "whole", "f1", "f2"])

    kind = df.schema[id_].dataType.simpleString()
    parts = settle(x.mapInArrow(hashed, f"row long, id {kind}, sha string, n long, whole boolean, f1 long, f2 long"), "shares")
    add = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % PRIME).cast("long").alias(c)
    long = parts.filter("not whole").groupBy("row", "id", "sha", "n").agg(add("f1"), add("f2"))
    return parts.filter("whole").drop("whole").unionByName(long)


def _texts(df: DataFrame, id_: str, text: str, by_piece: bool) -> DataFrame:
    """Texts with their fingerprints: (n, f1, f2, no, piece), or (n, f1, f2, id, t) whole."""
    x = df.select(F.col(id_).alias("id"), text_bytes(F.col(text)).alias("t"))

    def again(batches):
        for b in batches:
            for p in pieces(b, "t", 2 << 20):
                buf, off = buffers(p.column("t"))
                size = np.diff(off)
                count = np.maximum(1, -(-size // PIECE))
                row = np.repeat(np.arange(len(size)), count)
                no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                cuts = np.append(off[:-1][row] + no * PIECE, off[-1])
                share, after = piece_prints(buf, cuts), np.maximum(0, size[row] - (no + 1) * PIECE)
                f = [v[np.cumsum(count) - 1].astype(object) for v in share]  # what comes last isn't shifted
                for k in np.flatnonzero(after):
                    for j, base in enumerate(BASES):
                        f[j][row[k]] = (f[j][row[k]] + shifted(int(share[j][k]), base, int(after[k]))) % PRIME
                key = [size.astype(np.int64), *(v.astype(np.int64) for v in f)]
                if not by_piece:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, key), p.column("id"), p.column("t")], [*KEY, "id", "t"])
                    continue
                cut = pa.array([buf[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(v[row]) for v in key), pa.array(no.astype(np.int32)), cut], [*KEY, "no", "piece"])

    kind = df.schema[id_].dataType.simpleString()
    return x.mapInArrow(again, "n long, f1 long, f2 long, " + ("no int, piece binary" if by_piece else f"id {kind}, t binary"))


def _small(classes: DataFrame, n: int) -> DataFrame:
    return F.broadcast(classes) if n <= BROADCAST else classes


def unequal(df: DataFrame, id_: str, text: str, classes: DataFrame) -> DataFrame:
    """Keys of the classes that hold different texts."""
    members = _texts(df, id_, text, True).join(classes, KEY, "left_semi")
    ends = members.groupBy(*KEY, "no").agg(F.min("piece").alias("a"), F.max("piece").alias("b"))
    return ends.filter("a <> b").select(*KEY).distinct()


def exact_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row: of equal texts the row with the largest id stays."""
    facts = fingerprints(df, id_, text)
    best = F.max(F.struct("id", "row")).alias("best")
    classes = settle(facts.groupBy(*KEY).agg(F.count("*").alias("size"), best).filter("size > 1"), "classes")
    n = classes.count()
    few = _small(classes, n)
    mixed = settle(unequal(df, id_, text, few.select(*KEY)), "mixed") if n else classes.limit(0).select(*KEY)
    split = bool(n) and not mixed.isEmpty()
    if split:
        facts = facts.join(mixed, KEY, "left_anti")
    out = _verdict(facts.join(few, KEY, "left"))
    if split:
        own = _texts(df, id_, text, False).join(mixed, KEY, "left_semi")
        own = settle(own.select(F.monotonically_increasing_id().alias("row"), "id", F.sha2("t", 256).alias("sha"), "t"), "split")
        out = out.unionByName(_verdict(own.join(own.groupBy("t").agg(F.count("*").alias("size"), best), "t")))
    return out.withColumnRenamed("id", id_)


def _verdict(x: DataFrame) -> DataFrame:
    """Rows (row, id, sha) with their class's size and best row; both null where a text is there once."""
    keep_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return x.select("id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("size").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"), F.col("sha").alias("text_sha256"))
