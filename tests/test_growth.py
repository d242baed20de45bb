"""What tasks hold must not follow the size of the tables: the reviewer's findings on growth."""

from pyspark.sql import functions as F

from hearthlog.operators import entities, graph_store, joins, keyword_index, messages, search
from hearthlog.sources import json_ranges


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_mention_sorts_no_questions(spark):
    """questions are counted in a hash table; of names with one pos the first by name counts."""
    q = spark.createDataFrame([(1, "a letter to annbrown"), (2, "brown and smith"), (3, "ann brown, joe smith"), (4, None), (5, "none")], "q long, text string")
    names = spark.createDataFrame([("joe smith", 0), ("ann brown", 1), ("zoe brown", 1), ("ann brown", 7)], "name string, pos int")
    got = joins.name_mention(q, names)
    assert {r["q"]: r["name"] for r in got.collect()} == {1: "ann brown", 2: "joe smith", 3: "joe smith"}
    assert "SortAggregate" not in plan(got.select(F.col("q")))


def test_display_names_sort_no_names(spark):
    """friends and the beginnings of their names are counted in hash tables, with the same choice among ties."""
    friends = spark.createDataFrame([(n, p) for n, p in [("Anna Belle", 3), ("Anna Bell", 3), ("annabell", 1), ("Annabella Z", 0), ("Carlo", 0), ("Carlos", 0), ("Bob", 2)]], "name string, pos int")
    ids = spark.createDataFrame([(c,) for c in ("annabell_1", "annabelle_2", "annab_3", "carlosx_4", "bob_5", "bobby_6", "carl_7", "carlo_8")], "conversation string")
    got = messages.display_names(ids, friends)
    want = {"annabell_1": "annabell", "annabelle_2": "Anna Belle", "annab_3": "Annabella Z", "carlosx_4": "Carlos", "bob_5": "Bob", "bobby_6": "Bobby", "carl_7": "Carl", "carlo_8": "Carlo"}
    assert {r["conversation"]: r["name"] for r in got.collect()} == want
    assert "SortAggregate" not in plan(got)
    beginnings = joins.prefix_match(ids.select(F.col("conversation").alias("name")), friends)
    assert plan(beginnings).count("SortMergeJoin") >= 3  # no task gets all names


def test_python_tasks_hold_few_rows(spark, tmp_path, monkeypatch):
    """Batches are bounded for arrays and names; occurrences are handed on in small lots."""
    for k in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")
    docs = spark.createDataFrame([(i, "Ann met Bob " * 5) for i in range(3000)], "id long, text string").coalesce(1)
    json_ranges.write_arrays(docs, str(tmp_path / "a"))
    lines = [f.read_text() for f in (tmp_path / "a").glob("part-*")]
    assert sum(t.count('{"id"') for t in lines) == 3000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    for k in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")
    monkeypatch.setattr(entities, "SPANS", 7)
    names = spark.createDataFrame([("n", "ann"), ("n", "bob"), ("n", "bo")], "label string, name string")
    got = entities.entities(docs, names).collect()
    assert len(got) == 6000 and all((r["n"], r["first"]) == (5, 0 if r["name"] == "ann" else 8) for r in got)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_pairs_of_questions_and_documents_do_not_travel(spark, monkeypatch):
    """pairs are counted where the document stands; many questions' words are joined by a shuffle, with the same rows."""
    docs = spark.createDataFrame([(i % 50, f"w{i % 7} w{i % 5} w{i % 3} common" if i % 9 else None) for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(0, "w1 w2 w2"), (1, "common w6"), (2, None), (3, "missing")], "query long, text string")
    shown = lambda df: sorted((r["query"], r["id"], round(r["score"], 9)) for r in df.collect())
    got = search.bm25_many(docs, asked)
    assert "hashpartitioning(query" not in plan(got).replace("hashpartitioning(query#", "hashpartitioning(query").split("BroadcastExchange")[0]
    monkeypatch.setattr(search, "ASKED", 1)
    assert shown(got) == shown(search.bm25_many(docs, asked)) and shown(got)


def test_first_merge_reads_no_buckets(spark, tmp_path, monkeypatch):
    """a merge into an empty graph has nothing to replace, so its rows aren't worked out again to find buckets."""
    asked = []
    keep = graph_store.buckets_in
    monkeypatch.setattr(graph_store, "buckets_in", lambda rows: asked.append(1) or keep(rows))
    kind = "from_label string, from_name string, rel_type string, to_label string, to_name string, props map<string,string>, seq long"
    store = graph_store.GraphStore(spark, str(tmp_path / "g"), 4)
    store.merge(edges=spark.createDataFrame([("P", " a", "R", "Q", "b", {"x": "1"}, 0), ("P", "a", "R", "P", "a", None, 1)], kind))
    assert not asked and store.edges().count() == 2 and store.nodes().count() == 2
    store.merge(edges=spark.createDataFrame([("P", "a", "R", "Q", "b", {"x": "2", "since": "2020"}, 0)], kind))
    assert asked and sorted((r["to_name"], r["since"], r["props"].get("x")) for r in store.edges().collect()) == [("a", "", None), ("b", "2020", "2")]


def test_keyword_index_tasks_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    """tasks grow in number with texts and postings, postings travel packed by term, and questions that would open
    most postings are answered where the documents stand, with the same rows."""
    docs = spark.createDataFrame([(i, f"common w{i % 7} w{i % 5} w{i % 3} w{i % 7}" if i % 9 else None) for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(0, "w1 w2 w2"), (1, "common w6"), (2, None), (3, "missing")], "query long, text string")
    for k, v in {"TEXT": 100, "POSTINGS": 20, "LOT": 30, "PART": 10, "BLOCK": 4}.items():
        monkeypatch.setattr(keyword_index, k, v)
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "i"), 2)
    index.add(docs)
    assert index._forward(docs, "id", "text").rdd.getNumPartitions() >= 10  # two buckets
    assert index._blocks(index._packed(index.store.read("documents")), index.store.read("terms"), 4.0).rdd.getNumPartitions() >= 8
    assert index.store.read("postings").agg(F.sum("n")).first()[0] == docs.selectExpr("size(array_distinct(split(text, ' '))) n").filter("n > 0").agg(F.sum("n")).first()[0]
    want = sorted((q, i, -s) for q in range(4) for s, i in sorted((-round(r["score"], 6), r["id"]) for r in search.bm25_many(docs.fillna(""), asked).collect() if r["query"] == q)[:5])
    opened: dict = {}
    for dense, few in ((0, 10**6), (10**9, 10**6), (10**9, 1)):
        monkeypatch.setattr(keyword_index, "DENSE", dense)
        monkeypatch.setattr(keyword_index, "ASKED", few)
        assert sorted((r["query"], r["id"], r["score"]) for r in index.search_many(asked, 5, opened).collect()) == want
    assert opened["postings"] > 0
