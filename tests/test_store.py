"""Kept indexes and the kept graph: equal to their plain forms after appends, replaced rows and repeated batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import graph, search
from hearthlog.operators import keyword_index as words
from hearthlog.operators.graph_store import GraphStore
from hearthlog.operators.keyword_index import KeywordIndex
from hearthlog.operators.vector_index import VectorIndex
from hearthlog.operators.windows import stay_points, with_ordinal_id
from hearthlog.sources.store import Change, Conflict, Store, bucket_of
from hearthlog.streaming import stays


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- the store


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), 8)
    rows = lambda a, b: spark.range(a, b).withColumn("bucket", bucket_of(8, "id"))
    assert s.state() is None and s.read("x", kind="id long").count() == 0
    first = s.commit([Change("x", rows(0, 50))], {"n": 50}, "w", 3)
    assert s.applied("w", 3) and s.applied("w", 1) and not s.applied("w", 4) and not s.applied("v", 1)
    seen = s.read("x")
    before = files(tmp_path)
    s.commit([Change("x", rows(50, 60)), Change("y", rows(0, 1))], {"m": 1})
    assert sorted(r["id"] for r in s.read("x").collect()) == list(range(60)) and seen.count() == 50  # a reader keeps its version
    assert before.items() <= files(tmp_path).items()
    s.commit([Change("x", rows(0, 1).filter("false"), [2, 3])])
    assert {r["bucket"] for r in s.read("x").select("bucket").distinct().collect()} == {0, 1, 4, 5, 6, 7}
    assert s.read("x", [2]).count() == 0 and s.state()["facts"] == {"n": 50, "m": 1}
    with pytest.raises(Conflict):  # a writer that began with the first version
        s.commit([Change("x", rows(90, 91))], state=first)
    assert s.read("x").filter("id = 90").count() == 0
    want = sorted(r["id"] for r in s.read("x").collect())
    assert s.tidy() and sorted(r["id"] for r in s.read("x").collect()) == want and Store(spark, str(tmp_path / "t"), 99).buckets == 8


# --- keywords


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def sentences(seed, ids, n=30):
    r = random.Random(seed)
    return [(i, " ".join(f"w{int(r.expovariate(0.12))}" for _ in range(r.randint(0, n)))) for i in ids]


def ranking(spark, docs, q):
    return [(r["id"], round(r["score"], 6)) for r in search.top(search.bm25(docs, q), 1000, F.desc(F.round("score", 6)), "id").collect()]


@pytest.mark.parametrize("block,part", [(3, 20)])
def test_keyword_index(spark, tmp_path, monkeypatch, block, part):
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(words, "PART", part)
    a, b, c = sentences(1, range(60)), sentences(2, range(60, 100)), sentences(3, [5, 6, 70, 200])
    index = KeywordIndex(spark, str(tmp_path / "i"), 8)
    index.add(texts(spark, a), writer="w", batch=0)
    kept = files(tmp_path)
    questions = ["w0 w3 w9", "w1 w1 w30 unknown", "nothing here"]

    def check(rows):
        docs = texts(spark, rows)
        for q in questions:
            got = [(r["id"], round(r["score"], 6)) for r in index.search(q, 1000).collect()]
            assert sorted(got, key=lambda x: (-x[1], x[0])) == ranking(spark, docs, q)
        asked = spark.createDataFrame(list(enumerate(questions)), "query long, text string")
        full = search.bm25_many(docs, asked).collect()
        for n in (1, 5):
            want = []
            for q in range(len(questions)):
                want += [(q, i, s) for s, i in [(-s, i) for s, i in sorted((-round(r["score"], 6), r["id"]) for r in full if r["query"] == q)[:n]]]
            assert sorted((r["query"], r["id"], r["score"]) for r in index.search_many(asked, n).collect()) == sorted(want)

    check(a)
    index.add(texts(spark, b), writer="w", batch=1)
    index.add(texts(spark, b), writer="w", batch=1)  # the same batch again
    assert kept.items() <= files(tmp_path).items()  # nothing that was there is written anew
    check(a + b)
    index.add(texts(spark, c))  # replaced documents
    check([x for x in a + b if x[0] not in dict(c)] + c)
    index.add(texts(spark, [(300, None), (301, ""), (None, "w1 w2"), (302, "w1"), (302, "w2 w2")]))
    check([x for x in a + b if x[0] not in dict(c)] + c + [(300, ""), (301, ""), (302, "w2 w2")])


def test_question_reads_its_buckets(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"), 32)
    index.add(texts(spark, sentences(4, range(200))))
    blocks, weight = index.postings_of("w1 w2 missing")
    assert len(weight) == 2
    read = {p.split("bucket=")[1].split("/")[0] for p in blocks.inputFiles()}
    assert len(read) <= 2 and "PartitionFilters" in plan(blocks) and "In(term" in plan(blocks)


def test_top_k_opens_few_blocks(spark, tmp_path, monkeypatch):
    """Rare words decide: the postings of a word in every document aren't opened, and few documents are scored."""
    monkeypatch.setattr(words, "BLOCK", 16)
    r = random.Random(5)
    docs = texts(spark, [(i, "the " * r.randint(1, 4) + " ".join(f"x{r.randint(0, 400)}" for _ in range(12))) for i in range(1500)])
    index = KeywordIndex(spark, str(tmp_path / "i"), 8)
    index.add(docs)
    asked = spark.createDataFrame([(0, "the x1 x2"), (1, "the x3"), (2, "the the x9 x8")], "query long, text string")
    opened: dict = {}
    got = sorted((r["query"], r["id"], r["score"]) for r in index.search_many(asked, 3, opened).collect())
    full = search.bm25_many(docs, asked).collect()
    assert got == sorted((q, i, -s) for q in range(3) for s, i in sorted((-round(r["score"], 6), r["id"]) for r in full if r["query"] == q)[:3])
    assert opened["asked"] > 4500 and opened["postings"] < 500 and opened["documents"] < 400


# --- vectors


def near(rows, q, n, keep=lambda r: True):
    d = sorted((sum((x - y) ** 2 for x, y in zip(v, q)), i, k) for i, v, k in rows if keep((i, v, k)))
    return [(i, k) for _, i, k in d[:n]]


def test_vector_index(spark, tmp_path):
    r = random.Random(6)
    middle = [[r.gauss(0, 9) for _ in range(5)] for _ in range(12)]
    point = lambda: [x + r.gauss(0, 0.5) for x in r.choice(middle)]
    rows = [(i, point(), "a") for i in range(400)]
    rows[7:10] = [(i, rows[50][1], "a") for i in range(7, 10)]  # ties
    frame = lambda x: spark.createDataFrame(x, "id long, embedding array<double>, kind string")
    index = VectorIndex(spark, str(tmp_path / "v"), 12)
    index.upsert(frame(rows + [(900, None, "a"), (None, point(), "a"), (901, [1.0], "a"), (902, [float("nan")] * 5, "a")]), "w", 0)
    index.upsert(frame(rows), "w", 0)

    def check(rows):
        few = 0
        for q in [*middle[:4], rows[50][1], [0.0] * 5, [99.0] * 5]:
            read: list = []
            assert [(x["id"], x["kind"]) for x in index.search(q, 10, read=read).collect()] == near(rows, q, 10)
            assert [(x["id"], x["kind"]) for x in index.search(q, 3, F.col("kind") == "b").collect()] == near(rows, q, 3, lambda x: x[2] == "b")
            few += len(read) < 8
        assert few >= 4  # most cells stay unread
        assert [x["id"] for x in index.search(q, 10_000).collect()] == [i for i, _ in near(rows, q, 10_000)]

    check(rows)
    more = [(i, point(), "b") for i in (*range(30), *range(400, 430))]
    before = files(tmp_path)
    changed = index.upsert(frame(more), "w", 1)
    index.upsert(frame(more), "w", 1)
    check([x for x in rows if x[0] >= 30] + more)
    assert before.items() <= files(tmp_path).items() and changed["version"] == 2
    same = index.store.state()
    index.upsert(frame([(1000, rows[200][1], "c")]))
    moved = [b for b, g in index.store.state()["tables"]["vectors"]["parts"].items() if g != same["tables"]["vectors"]["parts"].get(b)]
    assert len(moved) == 1  # one cell


# --- the graph


EDGES = ", ".join(f"{c} string" for c in graph.EDGE) + ", props map<string,string>, seq long"


def edge_rows(seed, n):
    r = random.Random(seed)
    prop = lambda: {k: str(r.randint(0, 99)) for k in "xyz" if r.random() < 0.4} | ({"since": r.choice(["2020", "2021"])} if r.random() < 0.5 else {})
    return [("P", r.choice(["a", " a", "b", "c"]), "R", r.choice("PQ"), r.choice("abd"), prop() or None, i) for i in range(n)]


def shown(df):
    return sorted(repr(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in r.asDict().items())) for r in df.collect())


def test_graph_store(spark, tmp_path):
    rows = edge_rows(1, 80)
    frame = lambda x: spark.createDataFrame(x, EDGES)
    people = lambda x: spark.createDataFrame(x, "label string, name string, props map<string,string>, seq long")
    store = GraphStore(spark, str(tmp_path / "g"), 8)
    named = [("P", " a ", {"x": "1"}, 0), ("P", "zed", {"y": "2"}, 1), ("P", "a", {"x": "5", "y": "3"}, 9)]
    for k, (a, b) in enumerate([(0, 15), (15, 16), (16, 60), (60, 80)]):
        part = [(*x[:6], x[6] - a) for x in rows[a:b]]  # seq begins anew in each merge
        for _ in range(2):
            store.merge(people(named[k : k + 1]) if k < 3 else None, frame(part), "w", k)
        whole = graph.merge_edges(frame(rows[:b]))
        assert shown(store.edges()) == shown(whole.select(*store.edges().columns))
        assert shown(store.both_ways().select(*graph.EDGE, "props")) == shown(graph.both_ways(whole.select(*graph.EDGE, "props")))
    ends = graph.endpoints(graph.merge_edges(frame(rows))).select("*", F.create_map().cast("map<string,string>").alias("props"), F.lit(-1).alias("seq"))
    assert shown(store.nodes()) == shown(graph.merge_nodes(ends.unionByName(people(named))))
    seeds = spark.createDataFrame([("P", "a"), ("Q", "b"), ("P", "nobody"), ("P", "a")], "label string, name string")
    got = store.expand(seeds)
    assert shown(got) == shown(store.both_ways().join(seeds.distinct().toDF("from_label", "from_name"), ["from_label", "from_name"]).select(*got.columns))
    assert "BroadcastHashJoin" in plan(got) and "Exchange hashpartitioning" not in plan(got).split("BroadcastExchange")[0]
    # a merge of one edge leaves the other buckets' files and folders as they are
    before = store.store.state()["tables"]
    store.merge(edges=frame([("P", "zz", "R", "P", "zz", None, 0)]))
    after = store.store.state()["tables"]
    assert all(sum(before[t]["parts"].get(b) != g for b, g in after[t]["parts"].items()) == 1 for t in before)
    assert store.edges().filter("from_name = 'zz'").count() == 1 == store.both_ways().filter("from_name = 'zz'").count()


# --- ids by position


def test_ordinal_ids_with_more_columns(spark):
    r = random.Random(7)
    rows = [(r.randint(0, 500), i, f"more {i}", r.random()) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day int, key long, text string, x double").repartition(7)
    got = with_ordinal_id(df, ["day", "key"], "w_").collect()
    assert [(x["day"], x["key"], x["text"]) for x in sorted(got, key=lambda x: int(x["id"][2:]))] == [x[:3] for x in sorted(rows)]


# --- stay points of a stream


def test_stay_points_of_a_stream(spark, tmp_path):
    r = random.Random(8)
    t0, rows = datetime(2024, 1, 1), []
    for user in range(4):
        t = t0 + timedelta(minutes=user)
        for _ in range(60):
            t += timedelta(minutes=r.choice([1, 2, 5, 30, 200]), microseconds=r.randint(0, 999_999))
            rows.append((user, t, r.choice([1.0, 1.001, 1.02]), 2.0))
    schema = "user long, ts timestamp, lat double, lng double"
    want = stay_points(spark.createDataFrame(rows, schema), "user", "ts", "lat", "lng", gap_h=3, least_s=60)
    rows.sort(key=lambda x: x[1])
    # up to 25 minutes late and in no order within a batch; the last rows only move the watermark on
    late = sorted(rows, key=lambda x: x[1] + timedelta(minutes=r.randint(0, 25)))
    batches = [late[k : k + 40] for k in range(0, len(late), 40)] + [[(99, rows[-1][1] + timedelta(days=9), 0.0, 0.0)], [(99, rows[-1][1] + timedelta(days=9, minutes=1), 0.0, 0.0)]]
    for k, b in enumerate(batches):
        r.shuffle(b)
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(len(batches)):
        f = next((tmp_path / "in" / f"{k:03d}").glob("*.parquet"))
        target = flat / f"{k:03d}.parquet"
        target.write_bytes(f.read_bytes())
        import os

        os.utime(target, (1e9 + k, 1e9 + k))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
        out = stays.stay_points(stream, "user", "ts", "lat", "lng", gap_h=3, least_s=60, late="30 minutes")
        out.writeStream.format("memory").queryName("stays").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = spark.table("stays").collect()
    finally:
        spark.conf.unset(provider)
    assert sorted(tuple(x) for x in got) == sorted((x["user"], x["cell"], x["start_time"], x["end_time"], x["lat"], x["lng"], x["n"]) for x in want.collect())
    assert len(got) > 40
