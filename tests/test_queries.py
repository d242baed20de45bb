"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from hearthlog import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())


def test_whole_texts(spark):
    import re

    from hearthlog.values import EMOJI

    emoji = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in EMOJI) + "]")

    def once(t):
        half = len(t) // 2
        first = t[:half].strip()
        if len(t) < 6 or first != t[half:].strip():
            return t
        before = emoji.split(first)[0].strip()
        return before if len(before) >= 2 else first

    x = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {name: sorted(tuple(r) for r in catalog.queries()[name](spark, SF).collect()) for name in ("p5_whole_texts", "p23_whole_texts")}
    assert got["p5_whole_texts"] == sorted((i, once(t), once(f"{t}\n{t}"), once(f"{t} \U0001f606Ann {t} \U0001f606Ann")) for i, t in x)
    assert got["p23_whole_texts"] == sorted((i, t.strip(" "), f"answer {t}".strip(" ")) for i, t in x)
    assert len(x) == len(got["p5_whole_texts"]) == len(got["p23_whole_texts"])


def test_clusters_are_of_full_size(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = catalog.queries()["m1_kmeans"](spark, SF).collect()
    assert sorted(r["cluster"] for r in got) == list(range(7)) and sum(r["n"] for r in got) == n
    assert [r["k"] for r in catalog.queries()["m2_choose_k"](spark, SF).orderBy("k").collect()] == list(range(2, 20))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
