"""A keyword index that is kept, grows by new documents, and answers from its terms' buckets alone.

Tables of a store:
  documents  id, length, terms (term and count)          bucket by id
  terms      term, change of its document count, parts   bucket by term
  postings   blocks of at most BLOCK postings of a term, with the greatest count and the least length in them
             bucket by term and part

A term's postings are dealt into parts of about PART, so a word that all documents hold is no hot key, and each part is
ordered by what a posting can add to a score. Document counts and lengths that BM25 needs beside are facts of the store.

Defined cases: a null text is empty; documents without words count in the statistics; a null id isn't indexed; of
several rows of one id in a batch the greatest text counts; a document that is there already is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.store import Change, Store, arrow_limits, bucket_of, buckets_in, dealt
from .search import ASKED, EPSILON, K1, B, top

BLOCK, PART = 128, 1 << 17
#: Bytes of text, and postings, that a task of building is to hold, so tasks grow in number with the corpus; postings and
#: documents that a Python task packs at a time.
TEXT, POSTINGS, LOT, LOT_DOCS = 24 << 20, 3 << 20, 1 << 20, 1 << 16
#: Scores are compared to this many digits; what is nearer is a tie, and ties go to the smaller id.
DIGITS = 6
SLACK = 1e-5
#: Documents of a question that are scored first, by the number asked for, and the share of the score to be reached that
#: words which nominate no document may add.
HEAD, ASIDE = 4, 0.4
#: A question that would open more postings than this share of the documents has all documents scored where they stand.
DENSE = 0.25


def _share(tf: Column, dl: Column, average: float) -> Column:
    """What a posting adds to a score, by idf; it grows with tf and falls with dl (columns or numpy arrays)."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (average or 1.0)))


def _count(batches):
    """Words of texts (id, w, bucket) to each document's terms: (id, dl, terms, bucket)."""
    for b in batches:
        w = b.column("w")
        size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
        words = w.flatten().dictionary_encode()
        many = max(1, len(words.dictionary))
        key, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        off = np.concatenate([[0], np.cumsum(np.bincount(key // many, minlength=len(size)))])
        terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(key % many)), pa.array(tf, pa.int32())], ["term", "tf"])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), terms), b.column("bucket")], ["id", "dl", "terms", "bucket"])


def _lots(batches):
    """Batches of documents, gathered to about LOT postings or LOT_DOCS documents."""
    held, size, docs = [], 0, 0
    for b in batches:
        held.append(b)
        size, docs = size + len(b.column("terms").flatten()), docs + b.num_rows
        if size >= LOT or docs >= LOT_DOCS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, docs = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(off: np.ndarray, *values) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), v) for v in values]


def _pack(batches):
    """Documents (id, dl, terms) to packed postings, a row per term of a lot: (term, ids, tfs, dls)."""
    for lot in _lots(batches):
        held = lot.column("terms").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        e = held.flatten()
        doc = np.repeat(np.arange(lot.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False))
        term = e.field("term").dictionary_encode()
        code = term.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        off = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(term.dictionary)))])
        at = pa.array(doc[order])
        ids = lot.column("id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        out = pa.RecordBatch.from_arrays([term.dictionary, *_lists(off, ids.take(at), e.field("tf").take(pa.array(order)), lot.column("dl").combine_chunks().take(at))], ["term", "ids", "tfs", "dls"])
        for k in range(0, out.num_rows, LOT_DOCS):
            yield out.slice(k, LOT_DOCS)


def _cut(average: float, block: int):
    """Packed postings sorted by (term, part) to blocks. A term's part is held whole, about PART postings."""

    def blocks(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        b = table.to_batches()[0]
        term, part = b.column("term"), b.column("part").to_numpy()
        new = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False).astype(bool) | (part[1:] != part[:-1]))
        size = pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False)
        group = np.repeat(np.cumsum(new) - 1, size)
        ids, tf, dl = (b.column(c).flatten() for c in ("ids", "tfs", "dls"))
        x, y = tf.to_numpy().astype(np.float64), dl.to_numpy().astype(np.float64)
        by = ids.to_numpy() if pa.types.is_integer(ids.type) else pc.rank(ids, tiebreaker="dense").to_numpy()
        order = np.lexsort((by, -_share(x, y, average), group))
        first = np.flatnonzero(np.append(True, np.diff(group) > 0))  # of each group
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        at = np.flatnonzero(place % block == 0)
        row = pa.array(np.flatnonzero(new)[group[at]])
        tf, dl, order = tf.to_numpy()[order], dl.to_numpy()[order], pa.array(order)
        entries = pa.StructArray.from_arrays([ids.take(order), pa.array(tf), pa.array(dl)], ["id", "tf", "dl"])
        off = np.append(at, len(group))
        return pa.RecordBatch.from_arrays(
            [term.take(row), b.column("part").take(row), pa.array(place[at] // block, pa.int32()), pa.array(np.diff(off), pa.int32()), pa.array(np.maximum.reduceat(tf, at), pa.int32()), pa.array(np.minimum.reduceat(dl, at), pa.int32()), *_lists(off, entries), b.column("bucket").take(row)],
            ["term", "part", "no", "n", "max_tf", "min_dl", "entries", "bucket"],
        )

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += len(b.column("ids").flatten())
            if size >= LOT:
                t = pa.Table.from_batches(held).combine_chunks()
                last = pc.and_(pc.equal(t.column("term"), t.column("term")[-1]), pc.equal(t.column("part"), t.column("part")[-1])).to_numpy()
                whole = int(np.argmax(last))  # rows are sorted: from here on the last group
                if whole:
                    yield blocks(t.slice(0, whole))
                held = t.slice(whole).to_batches()
                size = sum(len(x.column("ids").flatten()) for x in held)
        if held:
            yield blocks(pa.Table.from_batches(held))

    return run


class KeywordIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, Store(spark, root, buckets)

    # --- building

    def _forward(self, docs: DataFrame, id_: str, text: str) -> DataFrame:
        """(id, dl, terms, bucket), standing by bucket: texts move once, into parts of about TEXT bytes, and are counted there."""
        arrow_limits(self.spark)
        n, kind = self.store.buckets, docs.schema[id_].dataType.simpleString()
        x = docs.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
        tasks = max(2 * n, -(-(x.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // TEXT))
        x = x.withColumns({"bucket": bucket_of(n, "id"), "share": dealt(tasks, n, "id")}).repartition(tasks, "bucket", "share")
        one = x.groupBy("bucket", "share", "id").agg(F.max("t").alias("t"))
        return one.select("id", tokens("t").alias("w"), "bucket").mapInArrow(_count, f"id {kind}, dl int, terms array<struct<term:string,tf:int>>, bucket int")

    def _packed(self, docs: DataFrame) -> DataFrame:
        kind = docs.schema["id"].dataType.simpleString()
        return docs.select("id", "dl", "terms").mapInArrow(_pack, f"term string, ids array<{kind}>, tfs array<int>, dls array<int>")

    def _blocks(self, packed: DataFrame, count: DataFrame, average: float) -> DataFrame:
        """Blocks of packed postings, standing by bucket; parts are sized by the term's number of postings here (count: term, df)."""
        n, kind = self.store.buckets, packed.schema["ids"].dataType.elementType.simpleString()
        tasks = max(2 * n, -(-(count.agg(F.sum("df")).first()[0] or 0) // POSTINGS))
        big = count.select("term", F.ceil(F.col("df") / PART).cast("int").alias("parts")).filter("parts > 1")  # at most one term in PART postings
        x = packed.join(F.broadcast(big), "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("parts")), F.lit(0)).cast("int"))
        x = x.withColumn("bucket", F.pmod(bucket_of(n, "term") + F.col("part"), F.lit(n)).cast("int")).select("bucket", "term", "part", "ids", "tfs", "dls")
        x = x.repartition(tasks, "bucket", dealt(tasks, n, "term", "part")).sortWithinPartitions("term", "part")
        return x.mapInArrow(_cut(average, BLOCK), f"term string, part int, no int, n int, max_tf int, min_dl int, entries array<struct<id:{kind},tf:int,dl:int>>, bucket int")

    def _terms(self, terms: DataFrame, sign: int = 1) -> DataFrame:
        x = terms.groupBy("term").agg((sign * F.count("*")).alias("df"))
        return x.select("term", "df", F.ceil(F.abs("df") / PART).cast("int").alias("parts"), bucket_of(self.store.buckets, "term").alias("bucket"))

    def add(self, docs: DataFrame, id_: str = "id", text: str = "text", writer: str | None = None, batch: int | None = None) -> dict:
        """The index with more documents. What is there is not counted again: new postings are added to their terms'
        buckets, and only buckets with postings of replaced documents are written anew. Texts move once, postings once,
        packed by term."""
        store, state = self.store, self.store.state()
        if state and store.applied(writer, batch, state):
            return state
        kind = docs.schema[id_].dataType.simpleString()
        empty = f"id {kind}, dl int, terms array<struct<term:string,tf:int>>"
        # the batch's documents are counted once: written first, read back for what derives from them
        placed = store.write("documents", self._forward(docs, id_, text), ("id",), placed=True)
        new = store.written(placed)
        old = store.read("documents", state=state, kind=empty)
        gone = old.join(new.select("id"), "id", "left_semi")
        facts = dict((state or {}).get("facts") or {"n": 0, "words": 0})
        add = new.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
        less = gone.agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
        facts["n"] += add["n"] - less["n"]
        facts["words"] += (add["words"] or 0) - (less["words"] or 0)
        average = facts["words"] / facts["n"] if facts["n"] else 0.0
        entries = lambda d: d.select("id", "dl", F.explode("terms").alias("e")).select("e.term", "id", "e.tf", "dl")
        tasks = -(-(add["words"] or 0) // POSTINGS)
        counted = store.write("terms", self._terms(new.select(F.explode("terms.term").alias("term"))), ("term",), tasks=tasks)
        fresh = store.written(counted)
        delta, changes = fresh, []
        if less["n"]:  # documents that are there already
            touched = buckets_in(gone)
            kept = store.read("documents", touched, state).join(new.select("id"), "id", "left_anti")
            changes.append(Change("documents", kept, touched, ("id",)))
            stale = entries(gone)
            more = self._terms(stale, -1)
            blocks = store.read("postings", state=state).join(stale.select("term").distinct(), "term", "left_semi")
            touched = buckets_in(blocks)
            rest = store.read("postings", touched, state).select("term", F.explode("entries").alias("e")).select("term", "e.id", "e.tf", "e.dl").join(gone.select("id"), "id", "left_anti")
            left = self._terms(rest)
            packed = rest.select("term", F.array("id").alias("ids"), F.array("tf").alias("tfs"), F.array("dl").alias("dls"))
            changes.append(Change("postings", store.write("postings", self._blocks(packed, left, average), ("term", "part", "no"), placed=True), touched))
            more = more.unionByName(left.withColumn("df", F.lit(0).cast("long")))  # what is written anew may have more parts than any batch had
            changes.append(Change("terms", more, (), ("term",)))
            delta = fresh.unionByName(more)
        changes.append(Change("documents", placed))
        changes.append(Change("postings", store.write("postings", self._blocks(self._packed(new), fresh, average), ("term", "part", "no"), placed=True)))
        changes.append(Change("terms", counted))
        every = store.read("terms", state=state, kind="term string, df long, parts int").select("term", "df").unionByName(delta.select("term", "df"))
        if state:  # a first batch holds each term once
            every = every.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        facts["mean"] = every.agg(F.avg(F.log(facts["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0
        return store.commit(changes, facts, writer, batch, state)

    # --- asking

    def _weights(self, terms: DataFrame, facts: dict) -> DataFrame:
        """(term, df, parts, idf) of a read of `terms`."""
        t = terms.groupBy("term").agg(F.sum("df").alias("df"), F.max("parts").alias("parts")).filter("df > 0")
        raw = F.log(facts["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return t.select("term", "df", "parts", F.when(raw < 0, EPSILON * facts["mean"]).otherwise(raw).alias("idf"))

    def postings_of(self, question: str, state: dict | None = None) -> tuple[DataFrame, dict[str, float]]:
        """Postings blocks of a question's words, read from their buckets alone, and each word's weight."""
        store, state = self.store, state or self.store.state()
        asked: dict[str, int] = {}
        for w in question.lower().split():
            asked[w] = asked.get(w, 0) + 1
        words = self.spark.createDataFrame([(w,) for w in asked] or [("",)], "term string").select("term", bucket_of(store.buckets, "term").alias("b"))
        at = {r["term"]: r["b"] for r in words.collect()}  # the question's words
        known = self._weights(store.read("terms", set(at.values()), state).filter(F.col("term").isin(*asked)), state["facts"]).collect()
        buckets = {(at[r["term"]] + p) % store.buckets for r in known for p in range(min(r["parts"], store.buckets))}
        blocks = store.read("postings", buckets, state).filter(F.col("term").isin(*[r["term"] for r in known]))
        return blocks, {r["term"]: r["idf"] * asked[r["term"]] for r in known}

    def scores(self, question: str, state: dict | None = None) -> DataFrame:
        """(id, score) of every document that shares a word with the question."""
        state = state or self.store.state()
        blocks, weight = self.postings_of(question, state)
        facts = state["facts"]
        x = blocks.select("term", F.explode("entries").alias("e"))
        w = F.coalesce(*[F.when(F.col("term") == t, F.lit(v)) for t, v in weight.items()], F.lit(0.0))
        gain = w * _share(F.col("e.tf"), F.col("e.dl"), facts["words"] / facts["n"] if facts["n"] else 0.0)
        return x.groupBy(F.col("e.id").alias("id")).agg(F.sum(gain).alias("score"))

    def search(self, question: str, n: int) -> DataFrame:
        """The first n documents by score, then id; those without any of the words have score 0."""
        state = self.store.state()
        found = self.scores(question, state)
        order = F.desc("score"), "id"
        if found.filter("score > 0").limit(n).count() < n:
            none = self.store.read("documents", state=state).select("id").join(found.select("id"), "id", "left_anti").withColumn("score", F.lit(0.0))
            found = top(found, n, *order).unionByName(none.orderBy("id").limit(n))
        return top(found, n, *order)

    def search_many(self, questions: DataFrame, n: int, opened: dict | None = None) -> DataFrame:
        """(query, id, score) of each question's first n documents that share a word with it.

        1. The first blocks of all words give a partial score of some documents. The HEAD * n best of these are scored
           whole; the n-th best of them is a score that the n-th best document reaches (`least`).
        2. Words are sorted by the most they can add. Those that together stay below a share ASIDE of `least` nominate
           no document. Of the others a block is opened only if its bound and the most of all other words reach
           `least`: each posting of a document that gets there is in an opened block.
        3. Documents whose opened postings and the words left aside could reach `least` are scored whole, by their own
           row. Questions that would open more postings than DENSE of the documents skip the postings: every document
           is scored for them where it stands, and only scores that reach `least` travel. Ties and rounding are held off
           by SLACK. With a negative mean idf, which gives negative weights, no bound holds and everything is opened.

        Questions' words and found pairs are sent to all tasks up to ASKED rows; more are joined by a shuffle.
        opened: is filled with the number of postings that were opened, of documents scored, and of all postings asked for.
        """
        state = self.store.state()
        facts = state["facts"]
        average = facts["words"] / facts["n"] if facts["n"] else 0.0
        bound = _share(F.col("max_tf"), F.col("min_dl"), average)
        postings, docs = self.store.read("postings", state=state), self.store.read("documents", state=state).select("id", "dl", "terms")
        asked = questions.select("query", F.explode(tokens("text")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")).persist()
        near = self._near(asked)
        held = lambda x: x.join(near(asked.select("term").distinct()), "term", "left_semi")
        most = held(postings).groupBy("term").agg(F.max(bound).alias("most"), F.sum("n").alias("size"))
        weights = self._weights(held(self.store.read("terms", state=state)), facts)
        asked = asked.join(weights, "term").select("query", "term", (F.col("idf") * F.col("times")).alias("w")).join(most, "term").withColumn("most", F.col("w") * F.col("most")).persist()
        gain = F.col("w") * _share(F.col("e.tf"), F.col("e.dl"), average)
        add = lambda x: x.select("query", "w", F.explode("entries").alias("e")).groupBy("query", F.col("e.id").alias("id")).agg(F.sum(gain).alias("part"))
        words_of = asked.groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("q"))

        def whole(found: DataFrame) -> DataFrame:
            """(query, id, score) of pairs, from the documents' own rows; up to ASKED pairs go to where the documents stand."""
            found = found.persist()
            x = docs.join(self._near(found)(found), "id").withColumn("tf", F.map_from_entries("terms")).join(near(words_of), "query")
            score = F.aggregate("q", F.lit(0.0), lambda s, t: s + F.coalesce(t["w"] * _share(F.element_at("tf", t["term"]), F.col("dl"), average), F.lit(0.0)))
            return x.select("query", "id", F.round(score, DIGITS).alias("score"))

        best = lambda x, by, k: x.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))).filter(F.col("r") <= k)
        # 1
        heads = add(postings.filter("no = 0").join(near(asked.select("query", "term", "w")), "term"))
        least = best(whole(best(heads, "part", HEAD * n).select("query", "id")), "score", n).filter(F.col("r") == n).select("query", F.col("score").alias("least"))
        # 2
        w = Window.partitionBy("query").orderBy("most", "term")
        x = asked.join(least, "query", "left").withColumn("least", F.coalesce(F.col("least"), F.lit(float("-inf"))) - SLACK if facts["mean"] >= 0 else F.lit(float("-inf")))
        x = x.withColumns({"below": F.sum("most").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("most").over(Window.partitionBy("query"))})
        x = x.withColumn("aside", F.col("below") < ASIDE * F.col("least")).persist()
        limits = x.groupBy("query").agg((F.first("least") - F.coalesce(F.sum(F.when(F.col("aside"), F.col("most"))), F.lit(0.0))).alias("reach"))
        nominating = x.filter("not aside").select("query", "term", "w", (F.col("least") - (F.col("all") - F.col("most"))).alias("need"))
        qualified = lambda by: postings.join(near(by), "term").filter((F.col("w") * bound >= F.col("need")) | (F.col("need") == float("-inf")))
        cost = qualified(nominating).groupBy("query").agg(F.sum("n").alias("cost")).persist()
        dense = cost.filter(F.col("cost") > DENSE * facts["n"]).select("query")
        # 3
        open_ = qualified(nominating.join(near(dense), "query", "left_anti"))
        found = add(open_).join(near(limits), "query").filter(F.col("part") >= F.col("reach")).select("query", "id").persist()
        if opened is not None:
            each = cost.agg(F.coalesce(F.sum(F.when(F.col("cost") > DENSE * facts["n"], 1)), F.lit(0)).alias("all"), F.sum(F.when(F.col("cost") <= DENSE * facts["n"], F.col("cost"))).alias("few")).first()
            opened |= {"postings": each["few"] or 0, "documents": found.count() + each["all"] * facts["n"], "asked": x.agg(F.sum("size")).first()[0] or 0}
        scored = whole(found)
        words = x.join(near(dense), "query", "left_semi").select("query", "term", "w", "least")
        passes = -(-words.count() // ASKED)
        for k in range(passes):
            scored = scored.unionByName(self._everywhere(docs, words.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == k), average))
        return best(scored, "score", n).drop("r")

    @staticmethod
    def _near(rows: DataFrame):
        """How rows are joined: sent to all tasks if they are few."""
        return F.broadcast if rows.limit(ASKED + 1).count() <= ASKED else lambda x: x

    def _everywhere(self, docs: DataFrame, words: DataFrame, average: float) -> DataFrame:
        """(query, id, score) of all documents that reach `least` of a question (query, term, w, least), scored where they stand."""
        arrow_limits(self.spark)
        rows = words.orderBy("term").toArrow()  # about ASKED rows at most
        kind, of = words.schema["query"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
        query, term = (rows.column(c).combine_chunks().dictionary_encode() for c in ("query", "term"))
        query, term = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (query, term))
        names, asked, many = query.dictionary, term.dictionary, len(query.dictionary)
        q, weight = query.indices.to_numpy(), rows.column("w").to_numpy()
        count = np.bincount(term.indices.to_numpy(), minlength=len(asked))  # rows are sorted by term
        start = np.cumsum(count) - count
        least = np.zeros(many)
        least[q] = rows.column("least").to_numpy()
        step = max(1, min(100, (1 << 21) // max(1, many)))

        def run(batches):
            for whole in batches:
                for k in range(0, whole.num_rows, step):
                    b = whole.slice(k, step)
                    e = b.column("terms").flatten()
                    at = pc.fill_null(pc.index_in(e.field("term"), value_set=asked), -1).to_numpy(zero_copy_only=False)
                    doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
                    hit = np.flatnonzero(at >= 0)
                    at, doc, tf = at[hit], doc[hit], e.field("tf").to_numpy()[hit].astype(np.float64)
                    share = _share(tf, b.column("dl").to_numpy().astype(np.float64)[doc], average)
                    times = count[at]
                    place = np.repeat(start[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    key = np.repeat(doc * many, times) + q[place]
                    score = np.bincount(key, np.repeat(share, times) * weight[place], b.num_rows * many)
                    met = np.zeros(len(score), bool)
                    met[key] = True
                    keep = np.flatnonzero(met & (score >= np.tile(least, b.num_rows)))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(keep % many)), b.column("id").take(pa.array(keep // many)), pa.array(score[keep])], ["query", "id", "score"])

        return docs.mapInArrow(run, f"query {kind}, id {of}, score double").withColumn("score", F.round("score", DIGITS))
