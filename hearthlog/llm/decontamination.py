"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

The index holds the test items; every passage of every training text is a query. Words are runs of letters
and digits (ASCII punctuation separates), lower-cased. Passages are windows of two strides, one stride
apart, where the stride is at least as long as the items of an index, so each copy of an item lies in a
passage whole. A score is divided by the item's own score for its full text, so one threshold fits all.

1. Per passage, the sum of its words' largest impacts bounds all its scores, and the sum of the largest
   within a block of items those of the block: passages below the threshold leave here (vectorised). 2. Block-max WAND on the rest gives all items at or above the threshold.
3. Of these an item leaks if 75 % of the five-word shingles of its question, and of its answer, are in the
   passage. The answer is the last sentence, or the last quarter of the words where there is but one.

Items go into indexes by length class (powers of two), and in blocks of at most ITEM_WORDS words, each sent to
the executors: a larger benchmark makes more blocks, not larger ones. BM25's statistics (number of items, mean
length, items a word is in) are those of the whole benchmark in every block, counted by grouped aggregation.

Defined cases: null or empty texts and items, and items without an id, match nothing; texts of any length are
whole; parts with fewer than five words are compared as one sequence; repeated rows are reported as often as they
occur, also under a null id; an empty table gives an empty result; items with equal texts are all reported; other
columns are ignored. keep_clean() drops the rows whose own text leaks, whatever their id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import APART, arrow_limits, buffers, chain, hash_words, pieces, settle, words

K1, B, THRESHOLD, OVERLAP, SHINGLE = 1.2, 0.75, 0.6, 0.75, 5
LEAST_STRIDE, BLOCK, NEAR, ITEM_WORDS = 64, 8, 2, 1_000_000
OUT = "doc_id long, item_id long, score double, passage long, question_overlap double, answer_overlap double"


def tokens(column: pa.Array):
    """Word hashes, each word's text, and where each text's words begin."""
    buf, off = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    start, end = words(buf, off, APART)
    doc = np.searchsorted(off, start, "right") - 1
    return hash_words(buf, start, end), doc, np.searchsorted(doc, np.arange(len(off)))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    return chain([h[i : len(h) - k + 1 + i] for i in range(k)]) if len(h) >= k > 0 else np.zeros(0, np.uint64)


class Index:
    """Postings by term with normalised impacts, their maxima, and maxima of blocks of BLOCK postings.

    stats: number of items, their mean length in words, and the number of items that hold each word.
    """

    def __init__(self, items: list[tuple[int, str]], stride: int, stats: tuple[int, float, dict] | None = None):
        self.stride, self.ids, self.parts = stride, [], []
        texts = pa.array([t for _, t in items], pa.large_string())
        h, _, first = tokens(texts)
        rows = [(i, h[a:b], split_at(t, b - a)) for (i, t), a, b in zip(items, first[:-1], first[1:]) if b > a]
        tf = [dict(zip(*[x.tolist() for x in np.unique(w, return_counts=True)])) for _, w, _ in rows]
        n, average, df = stats or statistics([w for _, w, _ in rows])
        post: dict[int, list] = {}
        for at, ((item, w, cut), d) in enumerate(zip(rows, tf)):
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / average)) for t, c in d.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                post.setdefault(t, []).append((at, x / own))
            self.ids.append(item)
            self.parts.append([(min(SHINGLE, len(p)), np.unique(grams(p, min(SHINGLE, len(p))))) for p in (w[:cut], w[cut:])])
        self.terms = np.array(sorted(post), np.uint64)
        lists = [post[int(t)] for t in self.terms]
        self.where = [[a for a, _ in p] for p in lists]
        self.impact = [[x for _, x in p] for p in lists]
        self.block = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impact]
        self.most = np.array([max(x) for x in self.impact]) if lists else np.zeros(0)
        # the same block maxima by blocks of items, for many passages at a time
        pairs = [sorted({}.fromkeys(a // NEAR for a in w)) for w in self.where]
        self.spans = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int64)
        self.item_block = np.array([x for b in pairs for x in b], np.int64)
        self.item_most = np.array([max(v for a, v in zip(w, x) if a // NEAR == k) for w, x, b in zip(self.where, self.impact, pairs) for k in b])
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each word's term number, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.some[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), max(0, len(self.terms) - 1))
        hit = self.terms[at] == h[maybe] if len(self.terms) else np.zeros(0, bool)
        out[maybe[hit]] = at[hit]
        return out

    def hopeful(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Of (passage, term) pairs, sorted, without repeats: the passages that some block of items lets reach the threshold."""
        if not len(passage):
            return passage
        names, at = np.unique(passage, return_inverse=True)
        total = np.bincount(at, weights=self.most[term])
        good = total[at] >= threshold - 1e-9
        names, at = np.unique(passage[good], return_inverse=True)
        term, wide, out = term[good], len(self.ids) // NEAR + 1, []
        step = max(1, (1 << 21) // wide)
        for a in range(0, len(names), step):
            lo, hi = np.searchsorted(at, [a, a + step])
            t, w = term[lo:hi], at[lo:hi] - a
            n = self.spans[t + 1] - self.spans[t]
            entry = np.repeat(self.spans[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            bound = np.bincount(np.repeat(w, n) * wide + self.item_block[entry], weights=self.item_most[entry], minlength=min(step, len(names) - a) * wide).reshape(-1, wide).max(axis=1)
            out.append(names[a : a + step][bound >= threshold - 1e-9])
        return np.concatenate(out) if out else names

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least `threshold`: block-max WAND over the terms' postings."""
        end = len(self.ids)
        cursors = [[self.where[t][0], 0, t] for t in terms]
        found = []
        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # blocks that hold the pivot item, and where the first of them ends
            limit, after = 0.0, end
            for c in cursors[: pivot + 1]:
                where, k = self.where[c[2]], c[1] // BLOCK
                while k < len(self.block[c[2]]) and where[min(len(where), (k + 1) * BLOCK) - 1] < item:
                    k += 1
                if k < len(self.block[c[2]]):
                    limit += self.block[c[2]][k]
                    after = min(after, where[min(len(where), (k + 1) * BLOCK) - 1] + 1)
            if limit >= threshold - 1e-12:
                if cursors[0][0] == item:
                    score = sum(self.impact[c[2]][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold - 1e-12:
                        found.append((item, score))
                    for c in cursors[: pivot + 1]:
                        self._move(c, item + 1)
                else:
                    for c in cursors:
                        if c[0] >= item:
                            break
                        self._move(c, item)
            else:
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    self._move(c, max(after, item + 1))

    def _move(self, c: list, to: int) -> None:
        where = self.where[c[2]]
        while c[1] < len(where) and where[c[1]] < to:
            c[1] += 1
        c[0] = where[c[1]] if c[1] < len(where) else len(self.ids)


def statistics(items: list[np.ndarray]) -> tuple[int, float, dict]:
    """Of items as word hashes: their number, mean length, and the number of items each word is in."""
    df: dict[int, int] = {}
    for w in items:
        for t in np.unique(w).tolist():
            df[t] = df.get(t, 0) + 1
    return len(items), sum(map(len, items)) / max(1, len(items)), df


def split_at(text: str, n: int) -> int:
    """Where the answer's words begin: the last sentence, or the last quarter."""
    body = text.rstrip()
    k = max(body.rfind(x, 0, len(body) - 1) for x in (". ", "? ", "! ", ".\n", "?\n", "!\n"))
    if k >= 0:
        h, _, _ = tokens(pa.array([body[: k + 1]], pa.large_string()))
        if 0 < len(h) < n:
            return len(h)
    return max(1, n - n // 4) if n > 1 else n


def scan(column: pa.Array, index: Index, threshold: float = THRESHOLD):
    """(row, item, score, passage, overlaps) of a column of texts; the best passage of each row and item."""
    h, doc, first = tokens(column)
    if not len(h) or not len(index.terms):
        return
    term = index.find(h)
    hit = np.flatnonzero(term >= 0)
    stride, length = index.stride, np.diff(first)
    blocks = -(-length // stride)
    base = np.cumsum(blocks + 1) - (blocks + 1)
    at = base[doc[hit]] + (hit - first[doc[hit]]) // stride
    total = np.bincount(at, weights=index.most[term[hit]], minlength=int((blocks + 1).sum()) + 1)
    bound = total[:-1] + total[1:]
    owner = np.repeat(np.arange(len(length)), blocks + 1)
    local = np.arange(len(owner)) - base[owner]
    # a passage starts in each block; that of the last block is part of the one before
    ok = (bound >= threshold - 1e-9) & (local < np.maximum(blocks[owner] - 1, 1)) & (blocks[owner] > 0)
    wide = len(index.terms)
    key = np.sort(np.concatenate([(at[x] - back) * wide + term[hit][x] for back in (0, 1) for x in [np.flatnonzero((at >= back) & ok[np.maximum(at - back, 0)])]]))
    key = key[np.diff(key, prepend=-1) > 0]
    live = index.hopeful(key // wide, key % wide, threshold)
    best: dict = {}
    seen: dict = {}
    for w in live:
        row, k = int(owner[w]), int(local[w])
        a, b = first[row] + k * stride, min(first[row] + (k + 2) * stride, first[row + 1])
        found = np.unique(term[a:b])
        key = found.tobytes()
        if key not in seen:
            seen[key] = index.search([int(t) for t in found if t >= 0], threshold)
        shingled: dict = {}
        for item, score in seen[key]:
            share = []
            for size, part in index.parts[item]:
                if not len(part):
                    share.append(1.0)
                    continue
                if size not in shingled:
                    shingled[size] = grams(h[a:b], size)
                share.append(float(np.isin(part, shingled[size]).mean()))
            if min(share) >= OVERLAP and score > best.get((row, item), (-1,))[0]:
                best[row, item] = (score, k, *share)
    for (row, item), x in sorted(best.items()):
        yield (row, index.ids[item], *x)


def indexes(items: list[tuple[int, str]], stats: tuple[int, float, dict] | None = None) -> list[Index]:
    """One index for each class of lengths, with the statistics of all items."""
    by: dict[int, list] = {}
    for i, t in items:
        n = len(tokens(pa.array([t], pa.large_string()))[0])
        by.setdefault(max(LEAST_STRIDE, 1 << max(0, n - 1).bit_length()), []).append((i, t))
    if stats is None:
        stats = statistics([h for _, t in items if len(h := tokens(pa.array([t], pa.large_string()))[0])])
    return [Index(x, stride, stats) for stride, x in sorted(by.items())]


def _counted(items: DataFrame) -> DataFrame:
    """(item_id, word, n) of the items (item_id, text): its word hashes, with the item's number of words."""
    schema = pa.schema([("item_id", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            h, doc, first = tokens(b.column("text"))
            if len(h):
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
                doc = doc[new]
                yield pa.RecordBatch.from_arrays([b.column("item_id").cast(pa.int64()).take(pa.array(doc)), pa.array(h[new].view(np.int64)), pa.array(np.diff(first)[doc].astype(np.int64))], schema=schema)

    return items.mapInArrow(run, "item_id long, word long, n long")


def blocks(benchmark: DataFrame):
    """The indexes of each block of the benchmark, one block at a time, all with the statistics of the whole."""
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null")
    size = asked.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    n = -(-size // ITEM_WORDS)
    if n <= 1:
        if n:
            yield indexes(sorted((r["item_id"], r["text"]) for r in asked.collect()))
        return
    counted = settle(_counted(asked), "words")
    total = counted.groupBy("item_id").agg(F.first("n").alias("n")).agg(F.count("*"), F.avg("n")).first()
    held = counted.groupBy("word").agg(F.count("*").alias("items"))
    for k in range(n):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(n)) == k
        # about ITEM_WORDS words, whatever the benchmark's size
        own = counted.filter(mine).select("word").distinct().join(held, "word").toArrow()
        df = dict(zip(own["word"].to_numpy().view(np.uint64).tolist(), own["items"].to_pylist()))
        yield indexes(sorted((r["item_id"], r["text"]) for r in asked.filter(mine).collect()), (total[0], total[1], df))


def found(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text and test item that it leaks, with a hash of the text, which tells rows of one id apart."""
    spark = docs.sparkSession
    arrow_limits(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("passage", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    out = spark.createDataFrame([], f"doc_id long, text_hash long, {OUT.partition(', ')[2]}")
    body = F.col("text").cast("string")
    for built in blocks(benchmark):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(built))

        def run(batches, sent=sent):
            built = cloudpickle.loads(sent.value)
            for b in batches:
                for p in pieces(b, "text"):
                    ids, hashes, rows = p.column("doc_id").to_pylist(), p.column("text_hash").to_pylist(), []
                    for index in built:
                        rows += [(ids[r], hashes[r], *x) for r, *x in scan(p.column("text"), index, threshold)]
                    cols = list(zip(*rows)) or [()] * len(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        out = out.unionByName(docs.select("doc_id", F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInArrow(run, out.schema))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text and test item that it leaks."""
    return found(docs, benchmark, threshold).drop("text_hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no test item."""
    bad = found(docs, benchmark).select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__hash"]), "left_anti")
