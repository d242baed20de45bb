"""What travels between tasks must not grow faster than the input."""

import random

import numpy as np
from pyspark.sql import functions as F

from hearthlog.llm import jaccard

from .test_documents import jaccard_brute


def test_verification_moves_only_nodes_in_pairs(spark, monkeypatch):
    """op6: few pairs go to where the nodes' tokens stand; many are joined by a shuffle, with the same links."""
    nodes = spark.createDataFrame([(i, 4, list(range(i // 2, i // 2 + 4))) for i in range(20)], "node long, n long, tokens array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (4, 5), (6, 9)], "a long, b long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = jaccard._verified(pairs, nodes)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2
        monkeypatch.setattr(jaccard, "PAIRS", 1)
        many = jaccard._verified(pairs, nodes)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(0, 1), (4, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_min_hashes_travel_without_bitmaps(spark):
    """op6: a node's 24 keys are two numbers each; of nodes that meet under a key the nearest leader by bitmaps counts."""
    kind = "node long, n long, tokens array<long>, keys array<long>, bits array<long>"
    nodes = spark.createDataFrame([(i, 4, [1, 2, 3, 4], [7] * 8 if i < 3 else [i * 10 + k for k in range(8)], [0] * 16) for i in range(5)], kind)
    keyed = jaccard._keyed(nodes)
    assert keyed.columns == ["node", "key"] and keyed.count() == 5 * 24
    seen = nodes.select("node", "n", F.size("tokens").alias("all"), "bits", F.col("node").alias("g"))
    met = {r["a"]: r["b"] for r in jaccard._leaders(keyed, seen, 0).collect()}
    assert len(met) == 2 and set(met) | set(met.values()) == {0, 1, 2}


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_few_bytes_a_shingle_travel_in_many_ranges(spark):
    """op6: with so many hash ranges that each holds a shingle or two of a text, names don't outgrow the shingles (21 bytes a shingle before)."""
    r = random.Random(3)
    docs = _texts(spark, [(i, " ".join(f"w{r.randint(0, 9999)}" for _ in range(504))) for i in range(40)]).coalesce(1)
    sent = jaccard._first_lists(docs, 4096).agg(F.sum(F.length("lists"))).first()[0]
    assert sent < 7 * 40 * 500


def test_sizes_of_sets_that_link_are_two_classes_apart_at_most():
    n = np.arange(1, 1_000_000)
    assert (jaccard.grade(4 * n // 3).astype(int) - jaccard.grade(n) <= 2).all() and (np.diff(jaccard.grade(n).astype(int)) >= 0).all()


def test_links_at_the_threshold_and_repeated_rows(spark, monkeypatch):
    """op6: no link is lost by first shingles; rows found by a shuffle and rows that repeat an id and its text give the same."""
    r = random.Random(4)
    rows = []
    for n in (5, 6, 7, 8, 9, 12, 23, 40, 100, 300):
        base = [f"v{n}_{i}" for i in range(n)]
        for cut in range(0, n // 3 + 1, max(1, n // 16)):
            rows += [(len(rows), " ".join(base[cut:])), (len(rows) + 1, " ".join(base[: n - cut] + [f"x{r.random()}" for _ in range(cut // 2)]))]
    rows += rows[:9] + [(None, rows[0][1])]
    expected = jaccard_brute([x for x in rows if x[0] is not None])
    monkeypatch.setattr(jaccard, "ROWS", 1)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(_texts(spark, rows)).filter("doc_id is not null").collect())
    assert got == expected
