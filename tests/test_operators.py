"""Operators on rows made for their edges."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthlog.functions import emotion, text
from hearthlog.operators import aggregates, cluster, graph, joins, messages, search, training, windows
from hearthlog.plans import context


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


def test_text(spark):
    t = lambda v, f: one(spark, v, f)
    assert t("oh ok I didn't know 😆Gab oh ok I didn't know 😆Gab", text.reaction_duplicate) == "oh ok I didn't know"
    assert t("abcdef", text.reaction_duplicate) == "abcdef" and t("hi", text.reaction_duplicate) == "hi"
    assert t("long enough text here 😆Ann long enough text here 😆Ann", text.persona_text) == "long enough text here"
    assert t("hello IP Address: 1.2.3.4", text.persona_text) == "hello"
    assert [t(x, text.message_type) for x in ("You called Bo", "You reacted 😆", "Ann joined the video call", "so you called")] == ["system", "reaction", "system", "text"]
    assert t("see https://a.b/c now  (edited)", text.training_text) == "see now"
    who = "Élodie Saint-Yves"
    notices = ["created the group", "named the group Trip to Rome", "named the group", "changed the group name", "changed the group photo", "added Bob Ray to the group", "removed Bob from the group", "left the group", "set the nickname for Bob to the big one", "set your nickname to Big", "set the emoji to X", "changed the chat theme", "changed the theme", "pinned a message", "started a call", "started a video call", "started an audio call", "sent a live location"]
    for n in notices:
        assert t(f"so {who} {n}. then", text.training_text) in ("so then", "so"), n
    assert t(f"well 😂{who} (Jul 06, 2023 8:10:32 pm) yes ❤ Bob", text.training_text) == "well yes"
    assert t("they left the group and Bob pinned it", text.training_text) == "they left the group and Bob pinned it"
    assert t("Salut ,ça va?oui....... l ' ami ```a ,b?``` fin", text.french_chat) == "Salut, ça va ? oui... l'ami```a ,b?```fin" or "```a ,b?```" in t("Salut ,ça va?```a ,b?``` fin", text.french_chat)
    assert [t(x, text.device) for x in ("Android OS 6.0.1 API 23 (samsung, SM)", "android", "web_player osx 10", "Partner lg_x", "", None, "Toaster")] == ["Android (Samsung)", "Android", "Web Player", "Smart TV", "Unknown", "Unknown", "Toaster"]
    assert [t(x, text.partial_date) for x in ("Sep 2025", "2025", "Present", "", "odd")] == ["2025-09-01", "2025-01-01", "", "", "odd"]
    assert [t(x, text.day_month_year) for x in ("03 Jan 2026", "3 Foo 2026", "x")] == ["2026-01-03", "2026-00-03", "x"]
    assert tuple(t("1 Rue X, Lyon, Region Y, 69001, France", text.address)) == ("Lyon", "France") and tuple(t("France", text.address)) == ("Unknown City", "France")
    assert [t(x, text.is_low_quality) for x in ("", "lol", "😂😂", "ok then", "sent a photo of it", "one")] == [True, True, True, False, True, True]
    assert t("❤Ann Bo", text.is_emoji_reaction) and not t("hello Ann", text.is_emoji_reaction) and t("see www.x.y", text.is_noise)
    assert t("WAS_FRIEND_OF", text.relation_label) == "was friend of (PAST)" and t("Ride_X", text.activity_name) == "ride x" and t("Ride", text.activity_name) == "cycling"
    assert tuple(t('well {"v": -7, "d": 0.2} ok', text.vad_reply)) == (-1.0, 0.5, 0.2) and tuple(t("none", text.vad_reply)) == (0.0, 0.5, 0.5)
    assert tuple(t("<think>a b</think> c", text.think_split)) == ("a b", "c") and t("I live in my place", text.lives_here)
    assert text.grid_cell  # halves to even
    assert [one(spark, v, lambda c: text.grid_cell(c, 1.0), "double") for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, "12.7", text.safe_int) == 12 and one(spark, "x", text.safe_double) == 0.0


def test_relations(spark):
    said = spark.createDataFrame([("mom mom zoom", 10), ("hi", 60), ("hi", 5)], "t string, n int")
    got = [tuple(r["r"]) for r in said.select(text.classify_relation(text.relation_scores("t"), "n").alias("r")).collect()]
    # zoom is in both languages' lists and counts twice; family stands before colleague
    assert got[0][0] == "FAMILY_OF" and got[1][0] == "FRIEND_OF" and got[2] == ("MET", 0.5)


def test_emotions(spark):
    p = spark.createDataFrame([({"disgust": 0.5, "joy": 0.25, "surprise": 0.25},), ({},)], "p map<string,double>")
    rows = p.withColumn("e", emotion.harmonise("p")).select("e", emotion.dominant("e").alias("d"), emotion.vad("e").alias("v")).collect()
    assert rows[0]["d"] == "anger" and rows[0]["e"]["joy"] == 0.5 and abs(rows[0]["v"]["v"] - 0.5) < 1e-9 and rows[1]["d"] == "anger"
    r = p.limit(1).select(emotion.keyword_record(F.lit("joy"), F.lit(0.5), F.lit(0.2)).alias("k"), emotion.sentiment_label(F.lit(0.2)).alias("s")).first()
    assert tuple(r["k"]) == ("joy", 0.75, 0.6) and r["s"] == "Positive"


def chat(spark, minutes, who=None):
    t0 = datetime(2020, 1, 1)
    return spark.createDataFrame([("c", t0 + timedelta(seconds=round(m * 60)), i, (who or "ab" * 50)[i], f"m{i}") for i, m in enumerate(minutes)], "conversation string, date timestamp, ord long, sender_name string, text string")


def test_sessions(spark):
    x = chat(spark, [0, 1, 2, 18, 18 + 480, 18 + 960 + 1 / 60])
    assert [r["session"] for r in windows.with_session(x).orderBy("ord").collect()] == [1, 1, 1, 1, 1, 2]
    assert [r["session"] for r in windows.with_session(x, tempo_excludes_current=True).orderBy("ord").collect()][3] == 2
    docs = windows.session_documents(x).orderBy("session").collect()
    assert docs[1]["text"] == "[CONTEXT] b: m3\n[CONTEXT] a: m4\nb: m5" and docs[0]["message_count"] == 5
    assert windows.session_documents(x, max_msgs=2).count() == 4


def test_stays(spark):
    t0 = datetime(2020, 1, 1)
    rows = [("u", t0 + timedelta(seconds=s), la, 2.0) for s, la in ((0, 1.0), (299, 1.001), (400, 5.0), (700, 5.0), (700 + 3 * 3600, 5.0), (701 + 6 * 3600, 5.0))]
    got = windows.stay_points(spark.createDataFrame(rows, "u string, ts timestamp, lat double, lng double"), "u", "ts", "lat", "lng").collect()
    assert [(r["lat"], r["n"]) for r in got] == [(5.0, 3)]


def test_graph(spark):
    kind = "from_label string, from_name string, rel_type string, to_label string, to_name string, props map<string,string>, seq long"
    rows = [("P", " a ", "KNOWS", "P", "b", {"since": "2020", "w": "1"}, 1), ("P", "a", "KNOWS", "P", "b", {"since": "2021"}, 2), ("P", "a", "KNOWS", "P", "b", {"note": "x"}, 3), ("P", "a", "KNOWS", "P", "a", {}, 4), ("Game", "Chess Club", "IS_AT", "P", "b", {"count": "3", "weight": "1.5"}, 5)]
    e = spark.createDataFrame(rows, kind)
    merged = {(r["to_name"], r["since"]): r["props"] for r in graph.merge_edges(e).collect() if r["rel_type"] == "KNOWS"}
    assert merged == {("b", "2020"): {"since": "2020", "w": "1", "note": "x"}, ("b", "2021"): {"since": "2021", "note": "x"}, ("a", ""): {}}
    nodes = spark.createDataFrame([("P", "a ", {"x": "1", "y": "1"}, 1), ("P", "a", {"x": "2"}, 2), ("P", "lone", None, 3)], "label string, name string, props map<string,string>, seq long")
    assert {r["name"]: r["props"] for r in graph.merge_nodes(nodes).collect()} == {"a": {"x": "2", "y": "1"}, "lone": {}}
    flat = e.withColumn("from_name", F.trim("from_name"))
    assert graph.both_ways(flat).count() == 9
    assert {r["name"]: r["degree"] for r in graph.degree(graph.merge_nodes(nodes), flat, exclude=["A"]).collect()} == {"lone": 0}
    assert [r["fact"] for r in graph.facts(flat, ["chess"]).collect()] == ["Chess Club is at (CURRENT) b (P) [weight: 1.5 | count: 3]"]
    w = spark.createDataFrame([("x", None), ("y", 3.0)], "to_name string, weight double")
    assert {r["to_name"]: r["pct"] for r in graph.interest_profile(w).collect()} == {"x": 25.0, "y": 75.0}


def test_search(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d"), (4, "d")], "id int, content string")
    s = {r["id"]: r["score"] for r in search.bm25(docs, "a zz", "id", "content").collect()}
    assert s[3] == 0 and s[2] >= s[1] and len(s) == 4
    sem = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "content string, pos int")
    key = spark.createDataFrame([("z", 1), ("y", 2)], "content string, pos int")
    got = [(r["content"], r["semantic_rank"], r["bm25_rank"]) for r in search.fuse(sem, key).orderBy(*search.fused_order()).collect()]
    assert got == [("y", 2, 2), ("z", None, 1), ("x", 3, None)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, embedding array<double>")
    for metric in ("l2", "cos", "dot"):
        assert search.knn(v, [0.0, 1.0], 1, "id", metric=metric).first()["id"] == 2
    rows = spark.createDataFrame([("c", "s", "2020-01-01", 1)], "conversation string, source string, date string, message_count int")
    assert rows.filter(search.where("c", "s", "2019", "2021", 1)).count() == 1 and rows.filter(search.where(min_messages=2)).count() == 0 and rows.filter(search.keyword_where("t")).count() == 0


def test_context(spark):
    corpus = spark.createDataFrame([(i, f"text about river {i}", [float(i), 1.0]) for i in range(8)], "id int, content string, embedding array<double>")
    e = spark.createDataFrame([("Person", "Ann", "LIVES_IN", "City", "Lyon", {}, 1)], "from_label string, from_name string, rel_type string, to_label string, to_name string, props map<string,string>, seq long")
    (r,) = context.answer_context(corpus, e, "Does Ann like the river 3", [3.0, 1.0], names=["Ann"]).collect()
    assert r["context"].startswith("## Facts\nAnn lives in Lyon (City)\n\n## Messages\n") and "river 3" in r["context"]
    assert not context.route("hello!").needs_retrieval and context.route("x", lambda q: 'so {"people": ["A"], "zz": 1}').people == ["A"] and context.route("x y", lambda q: "no").search_query == "x y"
    assert context.committee("q", {"a": "A", "b": "B"}, lambda p: str(len(p.split("\n"))), 2)
    norm = spark.range(1).select(context.hashing_embedder(8)(F.lit("a b a")).alias("v")).first()["v"]
    assert len(norm) == 8 and abs(sum(x * x for x in norm) - 1) < 1e-9
    got = spark.range(1).select(context.stopword_language(F.lit("le chat est dans la maison")).alias("l"), context.gazetteer_entities(F.lit("in lyon"), {"City": ["Lyon", "Nice"]}).alias("n"), context.lexicon_emotions(F.lit("so happy")).alias("e")).first()
    assert got["l"] == "fr" and [tuple(x) for x in got["n"]] == [("City", "Lyon")] and got["e"]["joy"] == 1.0


def test_training(spark):
    x = chat(spark, [0, 1, 2, 3, 4, 40, 41, 42], who="abababab").withColumn("own", F.col("sender_name") == "b")
    x = x.withColumn("text", F.when(F.col("ord") == 1, "m1?").otherwise(F.col("text")))
    pairs = training.training_pairs(x, "conversation", "date", "ord", "own", "text").orderBy("start").collect()
    assert [[m["content"] for m in p["messages"]] for p in pairs] == [["m0", "m1?", "m2", "m3"], ["m6", "m7"]]  # m4 is answered too late
    m = spark.createDataFrame([("e", [("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "")])], "conv_id string, messages array<struct<role:string,content:string>>")
    (r,) = training.prepare(m, 50, "sys").collect()
    assert [tuple(x) for x in r["messages"]] == [("system", "sys"), ("user", "a b"), ("assistant", "c")]
    long_ = spark.createDataFrame([("e", [("user", "a " * 9), ("assistant", "c"), ("user", "d"), ("assistant", "e")])], "conv_id string, messages array<struct<role:string,content:string>>")
    assert [[x["content"] for x in r["messages"]] for r in training.prepare(long_, 6).collect()] == [["d", "e"]]
    assert m.select(training.role_sequence("messages").alias("s"), F.size(training.history("messages")).alias("n")).first() == ("user→user→assistant→user", 3)


def test_names_and_messages(spark):
    ids = spark.createDataFrame([("annbrown_123",), ("jeandupontx_9",), ("some_one_5",)], "conversation string")
    friends = spark.createDataFrame([("Ann Brown", 0), ("Jean Dupont", 1), ("Jean Dup", 2)], "name string, pos int")
    assert {r["conversation"]: r["name"] for r in messages.display_names(ids, friends).collect()} == {"annbrown_123": "Ann Brown", "jeandupontx_9": "Jean Dupont", "some_one_5": "Some One"}
    x = chat(spark, [0, 1, 2], who="aab").withColumns({"type": F.lit("text"), "language": F.lit("en"), "text": F.lit("a fine day in town")})
    assert messages.self_name(x) == "a" and messages.own_messages(x, "a").count() == 2 and messages.spoken(x, "a").count() == 3 and messages.spoken(x, "C").count() == 0
    assert messages.export_filter(x, "2020-06-01").count() == 3 and messages.export_filter(x, "2030-06-01").count() == 0 and [tuple(r) for r in messages.with_own_messages(x, "a").collect()] == [("c", 2)]
    q = spark.createDataFrame([(1, "what did ann brown say"), (2, "nothing"), (3, "and jeandupont?")], "q int, text string")
    assert {r["q"]: r["name"] for r in joins.name_mention(q, friends).collect()} == {1: "Ann Brown", 3: "Jean Dupont"}


def test_clusters_and_histogram(spark):
    v = spark.createDataFrame([(i, [float(i // 10 * 10), float(i % 10) / 10]) for i in range(30)], "id int, v array<double>")
    found = {r["k"]: r["silhouette"] for r in cluster.choose_k(v, "v", [2, 3, 4]).collect()}
    assert max(found, key=found.get) == 3
    x, _ = cluster.kmeans(v, "v", 3, n_init=2)
    assert [r["n"] for r in cluster.cluster_stats(x, "cluster", 4).orderBy("cluster").collect()] == [10, 10, 10, 0]
    assert cluster.sub_clusters(x, "v", "cluster", 0, 11).filter("sub_cluster = 0").count() == 10
    assert cluster.sample_per(x, "cluster", "id", 2).count() == 6 and cluster.sample_rows(x, "id", 4).count() == 4
    h = aggregates.histogram(spark.createDataFrame([(float(i),) for i in range(21)], "x double"), "x").orderBy("bin").collect()
    assert h[0]["n"] == 2 and sum(r["n"] for r in h) == 21 and len(h) == 20
    assert aggregates.training_steps(100, 4, 2, 3, 0.1) == (36, 3)


def test_language_vote_reads_cleaned_texts(spark):
    fr = "je suis dans la maison avec les enfants"
    odd = ["You changed the group photo to that of the house", "You reacted to the message that is for you", "Download file: the house and that of the other.zip", "Magnet:?the and of to is that with for", "bien vu https://x.example/" + "a" * 60]
    rows = [("c", t) for t in odd * 8] + [("c", fr), ("c", fr + "  \n " + fr), ("c", None)]
    rows += [("links", "HTTPS://x.example/" + "b" * 90 + " oui la")] * 3 + [("order", f"la une les des est que pour {i}") for i in range(10, 13)] + [("order", f"the and of {i} https://x.example/" + "c" * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r["k"]: r["language"] for r in aggregates.language_vote(df, "k", "text", context.stopword_language("text") == "fr", keep=30, least=20).collect()}
    assert got == {"c": "fr", "links": "en", "order": "fr"}
