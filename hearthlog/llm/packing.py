"""Packing by cutting-stock column generation.

Texts become token ids (a public byte-level vocabulary) and a closing id 1. A text longer than a sequence is
cut into full sequences and a rest. Lengths fall into bins of GRID tokens (rounded up), and one histogram of
at most SEQ / GRID bins goes to the driver, whatever the corpus holds. There a linear program over patterns
(how many pieces of each bin share a sequence) is solved by column generation: a revised simplex method holds
the basis, and a knapsack dynamic program over the bins' dual prices finds the next pattern. Pattern counts
are rounded down, and what they leave (less than one sequence a pattern) is packed first-fit decreasing, by
counts again. Last, documents are ranked within their bins and take the patterns' places in that order.

Ranks are counted in two levels (bin and chunk of documents, then within), so no bin is handled by one task.

Defined cases: null text is an empty text (one piece, the closing id); texts of any length are whole; special
strings of the vocabulary become their ids; documents with a null id are packed like others, under it; a repeated
row is packed as often as it occurs; pieces of one length are ranked by id, start and checksum, and pieces equal in
these too are interchangeable; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import array
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, settle

SEQ, GRID, CLOSING = 2048, 8, 1
VOCABULARY = "byte_bpe_50k.json"
#: Pieces a chunk of a bin holds at most, about: what one task ranks.
CHUNK = 100_000
#: The linear program stops this close to its lower bound.
GAP = 0.0005
#: Degenerate steps in a row after which the basis at hand is taken; any basis is a valid plan.
STALL = 300
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of a text as little-endian 32-bit bytes: those that `tokenizers` gives with this vocabulary file.

    They are computed by `tiktoken` from the file's own ranks, pattern and special strings, at a third of the cost
    (tested to be equal). A run of white space too long for its matcher makes it raise an error; `tokenizers` takes
    such a text.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        # the file spells each byte as a printable character: printable ones as themselves, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            return array.array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


def tokenize(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each row of docs (doc_id, text), with the checksum of their ids."""
    arrow_limits(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        import public_tokenizers

        encode = Encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        closing = np.array([CLOSING], "<u4").tobytes()
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + closing
                n = len(ids) // 4
                for at in range(0, n, SEQ):
                    part = ids[4 * at : 4 * (at + SEQ)]
                    for column, v in zip(out, (doc, at, len(part) // 4, zlib.crc32(part), n)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def _inverse(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination; like all arithmetic here without threaded libraries, which can hang beside a JVM."""
    n = len(m)
    a = np.concatenate([m.astype(float), np.eye(n)], axis=1)
    for c in range(n):
        r = c + int(np.argmax(np.abs(a[c:, c])))
        a[[c, r]] = a[[r, c]]
        a[c] /= a[c, c]
        factor = a[:, c].copy()
        factor[c] = 0
        a -= factor[:, None] * a[c]
    return a[:, n:]


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m * v).sum(axis=1)


def _price(dual: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern of most value; value[c] is the best with c units of room."""
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = sizes <= c
        gain = np.where(fit, dual + value[np.maximum(c - sizes, 0)], -1.0)
        j = int(np.argmax(gain))
        value[c], took[c] = value[c - 1], -1
        if gain[j] > value[c] + 1e-12:
            value[c], took[c] = gain[j], j
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(value[room]), pattern


def _start(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A first basis: greedy patterns, each used until one of its sizes runs out (so the columns are triangular)."""
    left, columns = demand.astype(float), np.zeros((len(sizes), len(sizes)))
    open_ = np.ones(len(sizes), bool)
    for _ in sizes:
        pattern, space, i = np.zeros(len(sizes)), room, len(sizes) - 1
        while i >= 0:
            if open_[i] and sizes[i] <= space:
                pattern[i] = space // sizes[i] if not pattern.any() and left[i] * sizes[i] >= (left * sizes).sum() / 2 else 1
                space -= int(pattern[i]) * sizes[i]
            i -= 1
        used = np.flatnonzero(pattern)
        out = used[np.argmin(left[used] / pattern[used])]
        left = np.maximum(left - left[out] / pattern[out] * pattern, 0)
        columns[:, out], open_[out] = pattern, False
    return columns


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with their counts, that hold exactly `demand` pieces of each size."""
    n = len(sizes)
    if not n:
        return []
    basis = _start(sizes, demand, room)
    inverse = _inverse(basis)
    x, bound = np.maximum(_times(inverse, demand), 0), (demand * sizes).sum() / room
    last = (0, x.sum())
    for step in range(40 * n):
        if x.sum() < last[1] - 1e-9 * last[1]:
            last = (step, x.sum())
        dual = inverse.sum(axis=0)
        best, pattern = _price(dual, sizes, room)
        bound = max(bound, (dual * demand).sum() / max(best, 1))  # no plan has fewer sequences
        if best <= 1 + 1e-7 or x.sum() <= max(bound * (1 + GAP), bound + 1) or step - last[0] > STALL:
            break
        way = _times(inverse, pattern)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / way[out]
            inverse = inverse - np.outer(way, row)
            inverse[out] = row
        x = np.maximum(_times(inverse, demand), 0)
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        p = np.round(basis[:, j]).astype(np.int64)
        k = min(int(x[j] + 1e-6), *[int(left[i] // p[i]) for i in np.flatnonzero(p)])
        if k > 0:
            plan.append((p, k))
            left -= k * p
    # first-fit decreasing on what is left, equal sequences together
    open_: list[list] = []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(left[i]):
            for seq in open_:
                if seq[0] >= sizes[i]:
                    break
            else:
                open_.append(seq := [room, np.zeros(n, np.int64)])
            seq[0] -= sizes[i]
            seq[1][i] += 1
    return plan + [(p, 1) for _, p in open_]


def places(histogram: dict[int, int]) -> list[tuple]:
    """(bin, first rank, end rank, pieces of the bin in a sequence, first sequence, place before): who sits where."""
    bins = np.array(sorted(histogram), np.int64)
    out, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, k in solve(bins, np.array([histogram[b] for b in bins]), SEQ // GRID):
        place = 0
        for i in np.flatnonzero(pattern)[::-1]:
            b, a = int(bins[i]), int(pattern[i])
            out.append((b, taken[b], taken[b] + a * k, a, sequence, place))
            taken[b] += a * k
            place += a
        sequence += k
    return out


def pack(pieces: DataFrame) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    chunks = max(8, -(-pieces.count() // CHUNK))
    p = pieces.withColumn("bin", F.ceil(F.col("length") / GRID).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)).cast("int"))
    counts = p.groupBy("bin", "chunk").agg(F.count("*").alias("n"))
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # SEQ / GRID rows at most
    seats = spark.createDataFrame(places(histogram), "s_bin int, first long, last long, a long, sequence long, place long")
    before = counts.select(F.col("bin").alias("b"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("bin").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bin", "chunk").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = p.withColumn("r", rank).join(before, (F.col("bin") == F.col("b")) & (F.col("chunk") == F.col("c"))).withColumn("r", F.col("r") + F.col("before"))
    # bounded: a few patterns a bin, SEQ / GRID bins
    seated = ranked.join(F.broadcast(seats), (F.col("bin") == F.col("s_bin")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("last")))
    at = F.col("r") - F.col("first")
    x = seated.withColumn("sequence_id", (F.col("sequence") + F.floor(at / F.col("a"))).cast("long")).withColumn("place", F.col("place") + at % F.col("a"))
    w = Window.partitionBy("sequence_id").orderBy("place")
    return x.withColumn("offset", (F.sum("length").over(w) - F.col("length")).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(settle(tokenize(docs, vocabulary), "pieces"))
