from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthlog.operators import aggregates, training
from hearthlog.plans import seams
from hearthlog.values import EMOTIONS


def test_models_as_columns(spark):
    x = spark.createDataFrame([("abc", "en"), (None, "en"), ("d", "xx")], "t string, l string")
    assert [r["n"] for r in x.select(seams.batched(lambda ts: [len(t) for t in ts], "long", 2)("t").alias("n")).collect()] == [3, 0, 1]
    assert [list(r["v"]) for r in x.select(seams.direct_vad(lambda ts: [(len(t), 0, 1) for t in ts])(F.col("t")).alias("v")).collect()] == [[3, 0, 1], [0, 0, 1], [1, 0, 1]]
    sure = lambda c: F.struct(*[F.lit(1.0 if e == "joy" else 0.0).alias(e) for e in EMOTIONS])
    assert [r["e"]["joy"] for r in x.select(seams.emotions_by_language("t", "l", {"en": sure}).alias("e")).collect()] == [1.0, 1.0, 0.2]


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    import os
    import uuid

    def load():
        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: [[float(len(texts)), float(len(t)), float(os.getpid())] for t in texts]

    model = seams.loaded(load, "array<double>", 16)
    x = spark.range(1000).repartition(12).select(F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("t"), "id")
    for _ in range(3):
        rows = x.select("id", model("t").alias("m")).collect()
        assert all(r["m"][0] <= 16 and r["m"][1] == (r["id"] % 7 if r["id"] % 10 else 0) for r in rows)
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) <= 8 and {str(int(r["m"][2])) for r in rows} <= set(loads)
    e = x.select(seams.emotion_model(seams.word_shares)(F.lit("happy")).alias("e"), seams.emotion_model(seams.word_shares)(F.lit(None).cast("string")).alias("n")).first()
    assert e["e"]["joy"] == 1.0 and e["n"]["fear"] == 0.2


def test_prompted_vad(spark):
    t0 = datetime(2020, 1, 1)
    texts = ["first message of all", "I am so very happy", "ok", "you called someone", "this is bad news"]
    x = spark.createDataFrame([("c", t0 + timedelta(minutes=i), i, "a", t) for i, t in enumerate(texts)], "conversation string, date timestamp, ord long, sender_name string, text string")
    rows = seams.prompted_vad(x, lambda p: '{"v": 0.8, "a": 0.6}' if p.endswith("happy") else "cannot say").orderBy("ord").collect()
    assert [(r["ord"], r["v"], r["a"], r["d"], round(r["dv"], 3)) for r in rows] == [(1, 0.8, 0.6, 0.5, 0.0), (4, 0.0, 0.5, 0.5, -0.8)]


def test_persona_prompts(spark):
    x = spark.createDataFrame([(i, 0, f"text {i}", 0.1, 0.0, 0.5, 0.2, 0.2) for i in range(30)], f"id int, k int, text string, {', '.join(e + ' double' for e in EMOTIONS)}")
    (r,) = seams.persona_prompts(x, "k", "id").collect()
    assert "mostly joy, sadness, neutral" in r["prompt"] and r["prompt"].count("\n- ") == 25


def test_reports_and_flags(spark):
    m = spark.createDataFrame([("e", [("user", "a b"), ("assistant", "c")]), ("f", [("user", "a"), ("user", "<|im_end|>")])], "conv_id string, messages array<struct<role:string,content:string>>")
    r = training.inspect(m, 2)
    assert r["lengths"].first()["over"] == 1 and r["patterns"].count() == 2
    assert r["diagnostics"].first().asDict() == {"examples": 2, "ends_with_user": 1, "adjacent_same_role": 1, "with_markers": 1, "with_system": 0}
    b = spark.createDataFrame([([("x", "one"), ("x", None), ("x", "two")],)], "c array<struct<type:string,text:string>>")
    assert b.select(training.flatten_content("c").alias("t")).first()["t"] == "one two"
    s = spark.createDataFrame([(0, 3), (2, 0), (0, 0)], "documents int, nodes int")
    assert aggregates.active(s).first()["active"] == 2
    f = spark.createDataFrame([(0.0, 1.0, "x", "t"), (48.0, 2.0, "lat48", "t"), (48.0, 2.0, "Paris", None)], "lat double, lng double, address string, ts string")
    assert f.filter(aggregates.valid_fix()).count() == 1 and f.filter(aggregates.sane_gps()).count() == 1
