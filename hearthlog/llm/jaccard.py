"""N-gram Jaccard self-join with a token-group matrix.

Words are runs of bytes other than white space, A-Z lower-cased; a text's set holds its distinct five-word
shingles as 64-bit hashes (a text with fewer words: the whole sequence; without words: the empty set). Two
texts link when 100 * |A and B| >= 75 * |A or B|. Result: components of links, none lost:

1. Texts with equal sets are one node (named by a hash of the set).
2. Two sets that link have an eighth of their shingles in common among the first 3/8 of each by hash. Those alone travel,
   packed by hash range, and nodes of which others of about their size hold fewer are done. The rest is read once more
   and travels whole in the same way: a node needs 75 % of its shingles in common with another.
3. The rest is partitioned into groups of similar nodes: nodes that agree in a min-hash gather around a
   leader, and those that really link with it are its group (components of such links).
4. The token-group matrix holds each group's token union. Shingles of one group only can't make links
   between groups; of the first half of its shingles by hash a node needs a quarter of its size in other groups.
   Those that have it look up their rarest ones (as many as a link can miss, plus one) in the matrix. Sizes, the tokens
   left from a common one on and a parity bitmap bound each overlap; then the overlap with the token union of each
   group found bounds that with its members, and only groups that qualify are opened and compared exactly.

Everything but step 3's choice of leaders is exact, and step 3 only saves work for step 4.

Defined cases: null or blank text: n_shingles 0, component = own id; repeated rows stay repeated; texts of any
length are whole; empty table: empty result; a null id is in the result with the component of its class, whose id
is the least that is not null.
Nodes are named by 64 bits (48 in step 2, where only those of two nodes that link must differ), tokens by 64 bits, in step 2
by 43 at least, of which only those of one text must differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_limits, buffers, chain, hash_words, mix, pieces, release, settle, words
from .graph import components

WORDS, PERCENT = 5, 75
HASHES, ROUNDS, BITS = 8, 4, 1024
#: Tokens a packed hash range holds, about; ranges grow in number with the corpus.
RANGE = 2_000_000
#: Pairs of nodes (two numbers each) that are sent to all tasks; more are joined by a shuffle of all nodes.
PAIRS = 1 << 19
#: Rows (a number each) that are sent to all tasks to find their texts; more are joined by a shuffle of all texts.
ROWS = 1 << 21
#: Of the shingles that two sets have in common at least, the share (1 / SHARE) that is to be among their first ones, in steps 2 and 4.
SHARE, LATE_SHARE = 6, 3
#: Per cent of a set's shingles that are its first ones, about.
FIRST = 100 - PERCENT + PERCENT // SHARE
_U = np.uint64


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: (offsets, hashes)."""
    buf, off = buffers(column)
    start, end = words(buf, off)
    h = hash_words(buf, start, end)
    doc = np.searchsorted(off, start, "right") - 1
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    out_doc, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        whole = doc[: 1 - WORDS] == doc[WORDS - 1 :]
        out = chain([h[i : len(h) - WORDS + 1 + i] for i in range(WORDS)])[whole]
        out_doc = doc[: 1 - WORDS][whole]
    first = np.cumsum(count) - count
    for k in range(1, WORDS):  # short texts: the whole sequence
        few = np.flatnonzero(count == k)
        if len(few):
            out = np.concatenate([out, chain([np.full(len(few), k, np.uint64), *[h[first[few] + i] for i in range(k)]])])
            out_doc = np.concatenate([out_doc, few])
    order = np.lexsort((out, out_doc))
    out, out_doc = out[order], out_doc[order]
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (out_doc[1:] != out_doc[:-1])
        out, out_doc = out[new], out_doc[new]
    return np.concatenate([[0], np.cumsum(np.bincount(out_doc, minlength=n))]), out


def names(off: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, which does not depend on order."""
    size = np.diff(off)
    zero = np.zeros(1, np.uint64)
    total = np.concatenate([zero, np.cumsum(mix(tokens.copy()), dtype=np.uint64)])
    other = np.concatenate([zero, np.cumsum(mix(tokens ^ _U(0x5DEECE66D1CE4E5B)), dtype=np.uint64)])
    return chain([size.astype(np.uint64), total[off[1:]] - total[off[:-1]], other[off[1:]] - other[off[:-1]]]).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node) of each row."""
    arrow_limits(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for b in batches:
            for p in pieces(b, "text"):
                off, tokens = shingles(p.column("text"))
                yield pa.RecordBatch.from_arrays([p.column("doc_id").cast(pa.int64()), p.column("text_hash"), pa.array(np.diff(off)), pa.array(names(off, tokens))], schema=schema)

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long")


def overlap(n):
    """Shingles that a set of n (a column or an array of whole numbers) has in common with one it links with, at least."""
    return -(-PERCENT * n // 100) if isinstance(n, np.ndarray) else F.ceil(n * PERCENT / 100)


def wanted(n, share: int):
    """Common shingles at least among the first n - overlap(n) + wanted(n) by hash of each of two sets that link."""
    return np.maximum(1, overlap(n) // share) if isinstance(n, np.ndarray) else F.greatest(F.lit(1), F.floor(overlap(n) / share))


def grade(n: np.ndarray) -> np.ndarray:
    """A class of sizes; sets that link are at most two classes apart."""
    return np.searchsorted((100 / PERCENT) ** (np.arange(1, 200) / 2), n, "right").astype(np.uint8)


# --- packed lists: 48 bits of a node's name, its class of sizes, a count of up to 255, and as many tokens of 40 bits

_LISTS = pa.schema([("part", pa.int32()), ("lists", pa.binary())])


def _low(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _wide(blob: bytes, m: int, n: int, at: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8, n * m, at).reshape(-1, n)
    return out.reshape(-1).view("<u8")


def _pack(name, size, count, tokens) -> bytes:
    return b"".join([np.array([len(name), len(tokens)], "<u4").tobytes(), _low(name, 6), size.tobytes(), count.astype("u1").tobytes(), _low(tokens, 5)])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, class of sizes, token) per token."""
    m, t = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    count = np.frombuffer(blob, "u1", m, 8 + 7 * m)
    return np.repeat(_wide(blob, m, 6, 8), count), np.repeat(np.frombuffer(blob, "u1", m, 8 + 6 * m), count), _wide(blob, t, 5, 8 + 8 * m)


def _deal(node: np.ndarray, n: np.ndarray, count: np.ndarray, tokens: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Lists by hash range of nodes (name, size, number of tokens here, tokens end to end)."""
    tokens = mix(tokens.copy())
    key = ((tokens >> _U(40)) % _U(ranges)).astype(np.int32)
    name, size = np.repeat(node.view(np.uint64) >> _U(16), count), np.repeat(grade(n), count)
    order = np.lexsort((name, key))
    key, name, size, tokens = key[order], name[order], size[order], tokens[order]
    new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (size[1:] != size[:-1]))[: len(key)]
    since = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    new |= since % 255 == 0
    cut = np.flatnonzero(np.diff(key)) + 1
    ks, blobs = [], []
    for a, b in zip([0, *cut], [*cut, len(key)]):
        if b > a:
            at = a + np.flatnonzero(new[a:b])
            ks.append(int(key[a]))
            blobs.append(_pack(name[at], size[at], np.diff(np.append(at, b)), tokens[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(blobs, pa.binary())], schema=_LISTS)


def _held(dealt: DataFrame) -> DataFrame:
    """(name, c): how many of its dealt tokens another node of about its size holds too."""
    out = pa.schema([("name", pa.int64()), ("c", pa.int64())])

    def common(key, table):
        parts = [_unpack(x.as_py()) for x in table.column("lists")]
        name, size, token = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((name, size, token))
        name, size, token = name[order], size[order].astype(np.int16), token[order]
        new = np.append(True, (token[1:] != token[:-1]) | (name[1:] != name[:-1]))
        name, size, token = name[new], size[new], token[new]
        same = (token[1:] == token[:-1]) & (size[1:] - size[:-1] <= 2)
        found, c = np.unique(name[np.append(same, False) | np.append(False, same)], return_counts=True)
        return pa.Table.from_arrays([pa.array(found.astype(np.int64)), pa.array(c.astype(np.int64))], schema=out)

    return dealt.groupBy("part").applyInArrow(common, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


def _first_lists(docs: DataFrame, ranges: int) -> DataFrame:
    """The first shingles of each text, dealt; equal sets of a batch travel once."""

    def spread(batches):
        for b in batches:
            for p in pieces(b, "text"):
                off, tokens = shingles(p.column("text"))
                name = names(off, tokens)
                _, once = np.unique(name, return_index=True)
                n = np.diff(off)[once]
                first = np.where(n > 0, n - overlap(n) + wanted(n, SHARE), 0)
                at = np.repeat(off[once] - np.cumsum(first) + first, first) + np.arange(first.sum())
                yield _deal(name[once], n, first, tokens[at], ranges)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(spread, "part int, lists binary")


def _whole_lists(nodes: DataFrame, ranges: int) -> DataFrame:
    """All tokens of nodes, dealt."""

    def spread(batches):
        for b in batches:
            tokens = b.column("tokens")
            yield _deal(b.column("node").to_numpy(), b.column("n").to_numpy(), pc.list_value_length(tokens).to_numpy(), pc.list_flatten(tokens).to_numpy().view(np.uint64), ranges)

    return nodes.select("node", "n", "tokens").mapInArrow(spread, "part int, lists binary")


def _few(rows: DataFrame) -> DataFrame:
    """The rows for a semi-join: sent to all tasks unless they are many."""
    return F.broadcast(rows) if rows.limit(ROWS + 1).count() <= ROWS else rows


def _ranges(tokens: int) -> int:
    return max(8, -(-tokens // RANGE))


def shared_nodes(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(node, n, tokens, keys, bits): nodes of docs (own: sets(docs)) of which 75 % of the shingles are in other nodes of about
    their size, with their shingles by hash, min-hashes and parity bitmap. Of each one that passes with its first shingles a
    row is read whole, found by a hash of its text and id."""
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def whole(batches):
        for b in batches:
            for p in pieces(b, "text"):
                off, tokens = shingles(p.column("text"))
                node, n = names(off, tokens), np.diff(off)
                node, n = node[n > 0], n[n > 0]
                off = np.concatenate([[0], np.cumsum(n)])
                keys = np.zeros((len(n), HASHES), np.int64)
                for k in range(HASHES if len(n) else 0):
                    keys[:, k] = np.minimum.reduceat(mix(tokens * _U(2 * k + 3) + _U(0x9E3779B97F4A7C15 >> k)), off[:-1]).view(np.int64)
                bits = np.bincount(np.repeat(np.arange(len(n)), n) * BITS + (mix(tokens.copy()) % _U(BITS)).astype(np.int64), minlength=len(n) * BITS).astype(np.uint8) & 1
                bits = np.packbits(bits.reshape(len(n), BITS), axis=1, bitorder="little").reshape(-1).view("<i8")
                lists = lambda o, v: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), lists(off, tokens.view(np.int64)), lists(np.arange(0, keys.size + 1, HASHES), keys.reshape(-1)), lists(np.arange(0, len(bits) + 1, BITS // 64), bits)], schema=out)

    named = lambda x: x.withColumn("name", F.shiftrightunsigned("node", 16))
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    one = own.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("x"), F.min("n_shingles").alias("n"))
    may = named(one).join(_held(_first_lists(docs, _ranges(total * FIRST // 100))), "name").filter(F.col("c") >= wanted(F.col("n"), SHARE))
    rows = settle(may.select(F.xxhash64("x.text_hash", "x.doc_id").alias("row")), "rows")
    text = F.col("text").cast("string")
    said = docs.select(text.alias("text"), F.xxhash64(F.xxhash64(text), F.col("doc_id").cast("long")).alias("row"))
    read = settle(said.join(_few(rows), "row", "left_semi").select("text").mapInArrow(whole, "node long, n long, tokens array<long>, keys array<long>, bits array<long>"), "read")
    each = read.groupBy("node", "n").agg(F.count("*").alias("rows"))
    total = read.agg(F.sum("n")).first()[0] or 0
    kept = settle(named(each).join(_held(_whole_lists(read, _ranges(total))), "name").filter(F.col("c") >= overlap(F.col("n"))).select("node", "rows"), "kept")
    found = read.join(_few(kept.select("node")), "node", "left_semi")
    # rows that repeat an id and its text
    nodes = settle(found if kept.filter("rows > 1").isEmpty() else found.dropDuplicates(["node"]), "nodes")
    release(rows, read, kept)
    return nodes


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Only tokens of nodes in pairs travel, and only once where the pairs are few."""
    pairs = settle(pairs, "pairs")
    few = pairs.limit(PAIRS + 1).count() <= PAIRS
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    if few:
        b = b.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    both = F.size(F.array_intersect("ta", "tb"))
    sized = a.join(F.broadcast(pairs) if few else pairs, "a").join(b, "b").filter((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))
    return sized.withColumn("both", both).filter(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, key): a node's single min-hashes and those of two and three in a row."""
    one = F.transform("keys", lambda v, i: F.xxhash64(i, v))
    two = F.transform("keys", lambda v, i: F.xxhash64(i, v, F.get("keys", (i + 1) % HASHES)))
    three = F.transform("keys", lambda v, i: F.xxhash64(i, v, F.get("keys", (i + 1) % HASHES), F.get("keys", (i + 2) % HASHES)))
    return nodes.select("node", F.explode(F.concat(one, two, three)).alias("key"))


def _leaders(keyed: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """For each node (node, n, g, all, bits) the leader of another group that its bitmap is closest to: (a, b).

    A leader stands for all nodes that agree in one, two or three min-hashes; each round draws others. Only minima are
    gathered for a key, however many nodes share it, and bitmaps join the pairs that meet, not the keys.
    """
    drawn = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("draw"), "node")).alias("x"), F.count("*").alias("c")).filter("c > 1")
    pairs = keyed.join(drawn.select("key", F.col("x.node").alias("node2")), "key").filter("node <> node2").select("node", "node2").distinct()
    other = seen.select(*[F.col(c).alias(f"{c}2") for c in ("node", "n", "g", "all", "bits")])
    met = pairs.join(other, "node2").join(seen, "node").filter((F.col("g") != F.col("g2")) & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2")) & _near())
    return met.groupBy("node").agg(F.min(F.struct(_apart().alias("d"), F.col("node2").alias("b"))).alias("x")).select(F.col("node").alias("a"), F.col("x.b").alias("b"))


def _apart():
    """Bits in which the parity bitmaps of two nodes differ: at most the number of tokens they differ in."""
    return sum((F.bit_count(F.get("bits", i).bitwiseXOR(F.get("bits2", i))) for i in range(BITS // 64)), F.lit(0))


def _near():
    """Whether the bitmaps let two nodes link."""
    return (100 + PERCENT) * (F.col("all") + F.col("all2") - _apart()) >= 2 * PERCENT * (F.col("n") + F.col("n2"))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes (node, n, tokens, keys) whose components are those of all links."""
    group = nodes.select("node", F.col("node").alias("g"))
    stars = lambda: group.filter("node <> g").select(F.col("node").alias("a"), F.col("g").alias("b"))
    keyed, slim = settle(_keyed(nodes), "keyed"), settle(nodes.select("node", "n", F.size("tokens").alias("all"), "bits"), "slim")
    for k in range(ROUNDS):
        new = settle(_verified(_leaders(keyed, slim.join(group, "node"), k), nodes), "stars")
        if new.isEmpty():  # groups stay as they are
            continue
        roots = components(stars().unionByName(new))
        group = settle(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("g")), "group")
    release(keyed, slim)
    member = settle(nodes.join(group, "node").select("node", "n", "g", "tokens", "bits"), "groups")
    k = wanted(F.col("n"), LATE_SHARE).cast("int")
    first = (F.col("n") - overlap(F.col("n")) + k).cast("int")
    held = member.select("node", "n", "g", F.explode(F.slice("tokens", F.lit(1), first)).alias("t"))
    between = held.select("t", "g").distinct().groupBy("t").agg(F.count("*").alias("f")).filter("f > 1")
    open_ = held.join(between, "t").groupBy("node", "n", "g").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s")).filter(F.size("s") >= k)
    open_ = open_.withColumns({"m": F.size("s"), "few": F.size("s") - k + 1})
    open_ = settle(open_.join(member.select("node", "bits", F.size("tokens").alias("all")), "node"), "open")
    asks = open_.select("node", "n", "g", "all", "bits", "m", F.posexplode(F.slice("s", F.lit(1), F.col("few"))).alias("j", "x"))
    asks = asks.select("node", "n", "g", "all", "bits", (F.col("m") - F.col("j")).alias("rest"), F.col("x.t").alias("t"))
    matrix = asks.select("t", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "g", "all", "bits", "rest")])
    # what two sets of these sizes have in common at least, and how much of it is among their first shingles
    both = F.ceil((F.col("n") + F.col("n2")) * PERCENT / (100 + PERCENT))
    early = F.least(*[wanted(F.col(c), LATE_SHARE) + both - overlap(F.col(c)) for c in ("n", "n2")])
    fits = (
        (F.col("g") != F.col("g2")) & ((F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("node2") < F.col("node")))) & (100 * F.col("n2") >= PERCENT * F.col("n"))
        & (F.least("rest", "rest2") >= early)  # what is left from a first common token on
        & _near()
    )
    met = settle(asks.join(matrix, "t").filter(fits).select("node", "g2", "node2").distinct(), "met")
    union = member.join(met.select("g2").distinct(), F.col("g") == F.col("g2"), "left_semi").select(F.col("g").alias("g2"), F.explode("tokens").alias("t")).groupBy("g2").agg(F.collect_set("t").alias("union"))
    bound = met.select("node", "g2").distinct().join(member.select("node", "n", F.col("tokens").alias("own")), "node").join(union, "g2").filter(100 * F.size(F.array_intersect("own", "union")) >= PERCENT * F.col("n"))
    opened = bound.select("node", "g2")
    pairs = met.join(opened, ["node", "g2"], "left_semi").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    return stars().unionByName(_verified(pairs, nodes))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of each row of docs, and (node, root) of the nodes that have links."""
    own = settle(sets(docs), "sets")
    return own, components(links(shared_nodes(docs, own)))


def _least(own: DataFrame, found: DataFrame, key) -> DataFrame:
    """(node, root, x): the least `key` of each component, copies reduced to one row a node before components gather."""
    each = own.filter("n_shingles > 0").groupBy("node").agg(F.min(key).alias("k")).join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "k")
    return each.select("node", "root").join(each.groupBy("root").agg(F.min("k").alias("x")), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    own, found = classes(docs)
    joined = own.join(_least(own, found, F.col("doc_id")).select("node", F.col("x").alias("component_id")), "node", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of docs: that with the smallest doc_id, a null id last; of different
    texts under one id the one with the least hash, of repeated rows one. Rows without words all stay."""
    own, found = classes(docs)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = _least(own, found, key).filter("node = root").select(F.col("x.doc_id").alias("__keep"), F.col("x.text_hash").alias("__hash")).distinct()
    text = F.col("text").cast("string")
    blank = F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")) == 0
    said = docs.withColumn("__blank", blank).withColumn("__text", F.xxhash64(text))
    kept = said.filter("not __blank").join(first, F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__text") == F.col("__hash")), "left_semi").dropDuplicates(["doc_id", "__text"])
    return kept.unionByName(said.filter("__blank")).drop("__blank", "__text")
