"""Retrieval: filters, BM25, nearest neighbours, rank fusion, reranking, the hybrid pipeline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Words of questions (a row per question and word) that are sent to all tasks; more are joined by a shuffle.
ASKED = 500_000


def where(conversation: str | None = None, source: str | None = None, date_from=None, date_to=None, min_messages: int | None = None) -> Column:
    """one condition of all that are given; Spark pushes it to the scan."""
    out = [F.lit(True)]
    if conversation:
        out.append(F.col("conversation") == conversation)
    if source:
        out.append(F.col("source") == source)
    if date_from:
        out.append(F.col("date") >= F.lit(date_from))
    if date_to:
        out.append(F.col("date") <= F.lit(date_to))
    if min_messages and min_messages > 1:
        out.append(F.col("message_count") >= min_messages)
    return reduce(lambda a, b: a & b, out)


def keyword_where(source: str | None = None, date_from=None) -> Column:
    """the narrower filter of the keyword side, on request."""
    return where(source=source, date_from=date_from)


def bm25_idf(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Document frequency and idf of every term; negative values become a share of the mean of all."""
    t = corpus.select(tokens(text).alias("w"))
    size = t.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))  # one row
    df = t.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(size))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scored(corpus: DataFrame, query: str, text: str = "text", score: str = "score") -> DataFrame:
    """V3: corpus with the score of every row; repeated words of the query count as often as they are there.

    Only term counts are shuffled; each document counts the query's words itself.
    """
    asked: dict[str, int] = {}
    for w in query.lower().split():
        asked[w] = asked.get(w, 0) + 1
    if not asked:
        return corpus.withColumn(score, F.lit(0.0))
    wanted = bm25_idf(corpus, text).filter(F.col("term").isin(*asked)).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("__idf"), F.first("avgdl").alias("__avg"))  # one row
    words = F.array(*map(F.lit, asked))
    x = corpus.join(F.broadcast(wanted)).withColumn("__w", tokens(text))
    x = x.withColumns({"__dl": F.size("__w"), "__hits": F.filter("__w", lambda t: F.array_contains(words, t))})
    parts = []
    for w, times in asked.items():
        tf = F.size(F.filter("__hits", (lambda word: lambda t: t == word)(w)))
        parts.append(F.coalesce(F.col("__idf")[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.col("__avg"))) * times, F.lit(0.0)))
    return x.withColumn(score, reduce(lambda a, b: a + b, parts)).select(*corpus.columns, score)


def bm25(corpus: DataFrame, query: str, id_: str = "id", text: str = "text") -> DataFrame:
    """V3: (id, score) of every document."""
    return bm25_scored(corpus.select(F.col(id_).alias("id"), F.col(text).alias("text")), query).select("id", "score")


def bm25_many(corpus: DataFrame, questions: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(query, id, score) of every pair of a question (query, text) and a document that share a word.

    The questions' words meet the corpus by equality of words, so pairs without a common word are never made.
    """
    idf = bm25_idf(corpus, text)
    asked = questions.select(F.col("query"), F.explode(tokens("text")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    few = asked.limit(ASKED + 1).count() <= ASKED
    asked = asked.join(idf, "term")
    # texts travel once, by id: a document's words and its pairs with questions are then counted where it stands
    placed = corpus.select(F.col(id_).alias("id"), F.col(text).alias("t")).repartition("id")
    docs = placed.select("id", tokens("t").alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    asked = asked.groupBy("term").agg(F.first("idf").alias("idf"), F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("query", "times")).alias("by"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("q.times")
    met = docs.join(F.broadcast(asked) if few else asked, "term").select("*", F.explode("by").alias("q"))
    return met.groupBy(F.col("q.query").alias("query"), "id").agg(F.sum(gain).alias("score"))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n in a total order."""
    return df.orderBy(*order).limit(n)


def distance(vector: str, query: list[float], metric: str = "l2") -> Column:
    """V2: squared Euclidean distance, or one minus the cosine, or the negative product."""
    q = F.array(*[F.lit(float(x)) for x in query])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.transform(vector, lambda x: x.cast("double"))
    if metric == "l2":
        return total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "dot":
        return -dot
    return 1 - dot / (F.sqrt(total(F.transform(v, lambda a: a * a))) * float(sum(x * x for x in query) ** 0.5))


def knn(vectors: DataFrame, query: list[float], n: int, id_: str = "id", vector: str = "embedding", condition: Column | None = None, metric: str = "l2") -> DataFrame:
    x = vectors if condition is None else vectors.filter(condition)
    return top(x.withColumn("distance", distance(vector, query, metric)), n, "distance", id_)


def fuse(semantic: DataFrame, keyword: DataFrame, content: str = "content", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two lists (content, pos from 1). Of equal contents in a list the last
    rank counts; semantic before keyword order breaks ties."""
    s = semantic.groupBy(content).agg(F.max("pos").alias("semantic_rank"), F.min("pos").alias("s_pos"))
    b = keyword.groupBy(content).agg(F.max("pos").alias("bm25_rank"), F.min("pos").alias("b_pos"))
    j = s.join(b, content, "full_outer")
    score = F.coalesce(1 / (k + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("bm25_rank")), F.lit(0.0))
    return j.withColumn("rrf_score", score)


def fused_order() -> list:
    return [F.desc("rrf_score"), F.asc_nulls_last("s_pos"), F.asc_nulls_last("b_pos")]


def overlap_score(text, query: str) -> Column:
    """V5: the offline reranker: share of the query's words that a text holds."""
    q = sorted(set(query.lower().split()))
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, q)))) / max(1, len(q))


def rerank(df: DataFrame, query: str, text: str, k: int, threshold: float | None = 0.0, scorer: Callable | None = None, order=()) -> DataFrame:
    """V5, F3, T4."""
    x = df.withColumn("rerank_score", (scorer or overlap_score)(text, query))
    if threshold is not None:
        x = x.filter(F.col("rerank_score") >= threshold)
    return top(x, k, F.desc("rerank_score"), *order)


def ranked(df: DataFrame, *order, n: int) -> DataFrame:
    """The first n rows with pos from 1. Only n rows meet in the ranking."""
    from pyspark.sql import Window

    return df.orderBy(*order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def hybrid(corpus: DataFrame, query: str, vector: list[float], n: int = 20, k: int = 5, condition: Column | None = None, threshold: float | None = 0.0, scorer=None, needs_retrieval: bool = True) -> DataFrame:
    """Vectors and keywords under one filter, fused, reranked, cut. corpus: id, content, embedding and what the filter names."""
    if not needs_retrieval:
        return corpus.limit(0).select("content", F.lit(0.0).alias("rrf_score"), F.lit(0.0).alias("rerank_score"))
    x = corpus if condition is None else corpus.filter(condition)
    semantic = ranked(x.withColumn("distance", distance("embedding", vector)).select("id", "content", "distance"), "distance", "id", n=n)
    # statistics are those of the whole corpus; each row is scored where it stands
    scored = bm25_scored(corpus, query, "content", "__score")
    scored = scored if condition is None else scored.filter(condition)
    keyword = ranked(scored.select("id", "content", F.col("__score").alias("score")), F.desc("score"), "id", n=n)
    fused = top(fuse(semantic, keyword), n, *fused_order())
    return rerank(fused, query, "content", k, threshold, scorer, fused_order()).select("content", "semantic_rank", "bm25_rank", "rrf_score", "rerank_score")
