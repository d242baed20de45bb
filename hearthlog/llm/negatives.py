"""Hard negatives: for each anchor and positive the best rows of other labels inside a band below the positive's score.

Vectors are whole numbers, floor(SCALE * x); a score is an inner product of two of them.

1. All vectors become blocks in a table. Their second moments, a matrix of the vectors' width, add up in a tree; its
   eigenvectors are an orthogonal rotation that puts most of a product into the leading components.
2. Anchors are taken in passes of at most ANCHORS (bounded, so they are sent to all tasks); each pass reads all blocks
   twice, for positives and, these known, for negatives.
3. A task walks through its blocks and keeps the best rows of each anchor so far. For a block it adds up products of
   rotated components, a slice after the other. What the rest can add is at most the product of the two residual
   norms, plus slack for rounding and for the rotation being orthogonal only nearly. A pair that can't reach the worst
   row kept, or lies outside the anchor's band, is dropped; rows without any open pair leave the block.
4. Pairs left are decided by products of whole numbers, exact in float64 below 2^53, else in Python's integers.
5. Each task sends its best rows of each anchor; the best of these are the result.

Defined cases: rows with a null label, vector or component or a component that isn't finite take no part; shorter
vectors count as if they ended in zeros; equal rows with an anchor's id are one anchor, other rows count each; other
rows are those with another id; a null id is no anchor and comes after all ids, as does the largest long, which counts
as null; anchors without positives, and positives without negatives, give no row; a product beyond the range of a long
counts as the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, settle_parts
from .vectors import EXACT, LONG, blocks, matrix, products, to_long, usable, whole

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Percent of the positive's score between which a negative's lies.
LEAST, MOST = 50, 95
#: Anchors of a pass, anchors a block is compared with at a time, and slices of the components.
ANCHORS, GROUP, SLICES = 16384, 512, 4
FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


class Side(NamedTuple):
    """Vectors with what the bounds need: rotated components, and norms of what follows each slice."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    rest: np.ndarray
    most: float

    def take(self, at) -> Side:
        return Side(self.ids[at], self.labels[at], self.whole[at], self.turned[at], self.rest[at], self.most)


class Turn(NamedTuple):
    """A rotation, the ends of its slices, and the slack of a product relative to the two norms."""

    matrix: np.ndarray
    ends: list[int]
    slack: float


def rotation(table: DataFrame, width: int) -> Turn:
    """Eigenvectors of the second moments, by falling eigenvalue."""

    def add(acc, block):
        x = matrix(block)
        with np.errstate(over="ignore", invalid="ignore"):
            return acc + x.T @ x

    moments = table.select("n", "width", "kind", "data").rdd.treeAggregate(np.zeros((width, width)), add, np.add)
    turn = np.linalg.eigh(moments)[1][:, ::-1] if np.isfinite(moments).all() else np.eye(width)
    off = np.abs(turn.T @ turn - np.eye(width)).sum()
    ends = sorted({-(-width * k // SLICES) for k in range(1, SLICES + 1)})
    # |fl(Rx) - Rx| and the rounding of the partial products stay below width^2 units in the last place of the norms
    return Turn(np.ascontiguousarray(turn), ends, float(off + 16 * (width + 1) ** 2 * 2.0**-53))


def side(block, turn: Turn) -> Side:
    x = matrix(block)
    with np.errstate(over="ignore", invalid="ignore"):
        y = x @ turn.matrix
        square = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(np.stack([square[:, e] if e < x.shape[1] else np.zeros(len(x)) for e in [0, *turn.ends]], 1))
    return Side(np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["labels"], "<i8"), x, y, rest, float(np.abs(x).max(initial=0)))


def open_pairs(a: Side, x: Side, turn: Turn, low: np.ndarray, high: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that `may` allows those whose product can lie between low and high, bounds of each anchor."""
    if not a.whole.shape[1] * a.most * x.most < EXACT:  # bounds in float64 don't hold
        return np.nonzero(may)
    rows, part, begin = np.arange(len(x.ids)), np.zeros(may.shape), 0
    for s, end in enumerate(turn.ends):
        live = may.any(0)
        if not live.all():  # rows without an open pair go
            rows, may, part = rows[live], may[:, live], part[:, live]
        part += a.turned[:, begin:end] @ x.turned[rows, begin:end].T
        margin = np.outer(a.rest[:, s + 1], x.rest[rows, s + 1]) * (1 + 1e-9) + turn.slack * np.outer(a.rest[:, 0], x.rest[rows, 0]) + 1e-6
        may = may & (part + margin >= low[:, None]) & (part - margin <= high[:, None])
        begin = end
        if may.sum() * 16 < may.size:  # few pairs are left: their whole products are cheaper than another slice of all
            break
    i, j = np.nonzero(may)
    return i, rows[j]


def scores(a: Side, x: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the pairs, exact; beyond a long the nearest long."""
    if a.whole.shape[1] * a.most * x.most < EXACT:
        return np.concatenate([np.einsum("ij,ij->i", a.whole[i[k : k + 65536]], x.whole[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)
    out = np.zeros(len(i), np.int64)
    for k in np.unique(i):
        at = np.flatnonzero(i == k)
        out[at] = to_long(products(a.whole[k : k + 1], x.whole[j[at]])[0])
    return out


class Kept:
    """The best `n` (score, id) of each key so far: higher scores first, then smaller ids."""

    def __init__(self, keys: int, n: int):
        self.n, self.worst, self.full = n, np.zeros(keys, np.int64), np.zeros(keys, bool)
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key, score, id_) -> None:
        key, score, id_ = np.append(self.key, key), np.append(self.score, score), np.append(self.id, id_)
        by = np.lexsort((id_, ~score, key))  # ~score orders like -score and has no overflow
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self.key, self.score, self.id = key[place < self.n], score[by][place < self.n], id_[by][place < self.n]
        last = place == self.n - 1
        self.full[key[last]], self.worst[key[last]] = True, score[by][last]

    def floor(self) -> np.ndarray:
        """A score below this can't be among the best any more."""
        return np.where(self.full, self.worst.astype(float) - 1024 * np.spacing(np.abs(self.worst.astype(float))), -np.inf)


def _same(a: Side, x: Side, turn: Turn, kept: Kept, base: int) -> None:
    """Rows of an anchor's label, into kept."""
    for label in np.intersect1d(a.labels, x.labels):
        at, on = np.flatnonzero(a.labels == label), np.flatnonzero(x.labels == label)
        p, q = a.take(at), x.take(on)
        i, j = open_pairs(p, q, turn, kept.floor()[base + at], np.full(len(at), np.inf), p.ids[:, None] != q.ids)
        kept.add(base + at[i], scores(p, q, i, j), q.ids[j])


def _other(a: Side, x: Side, turn: Turn, kept: Kept, base: int, band: np.ndarray) -> None:
    """Rows of other labels inside the bands (anchor, place, low and high), into kept; keys are anchor * places + place."""
    places = band.shape[1]
    keys = (base + np.arange(len(a.ids)))[:, None] * places + np.arange(places)
    low, high = band[:, :, 0], band[:, :, 1]
    none = low > high
    reach = np.where(none, np.inf, np.maximum(low.astype(float), kept.floor()[keys])).min(1)
    top = np.where(none, -np.inf, high.astype(float)).max(1)
    i, j = open_pairs(a, x, turn, reach - 1, top + 1, (a.labels[:, None] != x.labels) & np.isfinite(reach)[:, None])
    s = scores(a, x, i, j)
    for k in range(places):
        inside = (s >= low[i, k]) & (s <= high[i, k])
        kept.add(keys[i[inside], k], s[inside], x.ids[j[inside]])


def _bands(positive: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Least and greatest whole score with LEAST * p <= 100 * s <= MOST * p."""
    out = np.empty((*positive.shape, 2), np.int64)
    for at in np.ndindex(positive.shape):
        p = int(positive[at])
        out[at] = (-(-LEAST * p // 100), MOST * p // 100) if there[at] else (1, 0)
    return out


def _walk(table: DataFrame, anchors: list, turn: Turn, places: int, n: int, band: np.ndarray | None) -> DataFrame:
    """(anchor, place, score, id): each task's best rows of each anchor and place; a pass over all blocks."""
    sent = table.sparkSession.sparkContext.broadcast((anchors, turn, band))

    def run(batches):
        packed, turn, band = sent.value
        sides, count = [side(b, turn) for b in packed], 0
        groups = []
        for a in sides:
            for k in range(0, len(a.ids), GROUP):
                groups.append((count + k, a.take(slice(k, k + GROUP))))
            count += len(a.ids)
        kept = Kept(count * places, n)
        for b in batches:
            for row in b.to_pylist():
                x = side(row, turn)
                for base, a in groups:
                    if band is None:
                        _same(a, x, turn, kept, base)
                    else:
                        _other(a, x, turn, kept, base, band[base : base + len(a.ids)])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kept.key // places, kept.key % places, kept.score, kept.id)], schema=FOUND)

    return table.mapInArrow(run, "anchor long, place long, score long, id long")


def _best(found: DataFrame, n: int) -> DataFrame:
    """The first n of each anchor and place, with their rank from 1; at most n rows a task meet."""
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _passes(anchors: DataFrame):
    """Packed anchors by at most ANCHORS; the driver holds one pass."""
    held, n = [], 0
    for row in anchors.toLocalIterator():
        if n + row["n"] > ANCHORS and held:
            yield held
            held, n = [], 0
        held.append({k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.asDict().items()})
        n += row["n"]
    if held:
        yield held


def hard_negatives(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are ids divisible by `every`."""
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kept = df.filter(usable(df, vector) & F.col(label).isNotNull()).select(id_, vector, label)
    width = kept.agg(F.max(F.size(vector))).first()[0]
    if width is None:
        return spark.createDataFrame([], schema)
    table = settle(blocks(kept, id_, vector, scale, width, label), "vectors")
    asking = settle(blocks(kept.filter(F.col(id_) % every == 0).dropDuplicates(), id_, vector, scale, width, label), "anchors")
    turn = rotation(table, width)

    def mined():
        for held in _passes(asking):
            ids = np.concatenate([np.frombuffer(b["ids"], "<i8") for b in held])
            pos = settle(_best(_walk(table, held, turn, 1, positives, None), positives).select("anchor", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
            score, there = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), bool)
            for r in pos.toLocalIterator():  # positives of ANCHORS anchors
                score[r["anchor"], r["place"] - 1], there[r["anchor"], r["place"] - 1] = r["positive_score"], True
            found = _best(_walk(table, held, turn, positives, negatives, _bands(score, there)), negatives)
            names = spark.createDataFrame(pa.table({"anchor": np.arange(len(ids)), "anchor_id": ids}))
            out = found.join(pos.withColumn("place", F.col("place") - 1), ["anchor", "place"]).join(F.broadcast(names), "anchor")
            known = lambda c: F.when(F.col(c) < LONG, F.col(c))
            yield out.select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    return settle_parts(spark, mined(), "negatives", schema)
