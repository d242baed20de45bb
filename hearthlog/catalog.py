"""All queries of the library's own operators with their SQL (DuckDB), over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import values as V
from .functions import emotion as E
from .functions import text as T
from .operators import aggregates as A
from .operators import cluster as C
from .operators import graph as G
from .operators import joins as J
from .operators import messages as P
from .operators import search as S
from .operators import training as Q
from .operators import windows as W
from .operators.entities import entities, first_mention
from .operators.graph_store import GraphStore
from .operators.keyword_index import KeywordIndex
from .operators.vector_index import VectorIndex
from .sources import exports as X
from .sources.json_ranges import rows_of, write_arrays
from .sources.pages import export_files
from .sources.store import shared_folder

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(col: str, keys) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {s(k)})" for k in keys) + ")"


# --- messages: events as a chat, user_id the conversation


def messages(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("conversation"), F.col("ts").alias("date"), F.col("event_id").alias("ord"), F.col("event_type").alias("sender_name"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("text"), "value")


M = "m AS (SELECT user_id AS conversation, ts AS date, event_id AS ord, event_type AS sender_name, 'event ' || event_id AS text, value FROM events)"
GAP = f"{M}, g AS (SELECT *, epoch_us(date) / 60e6 - lag(epoch_us(date)) OVER w / 60e6 AS gap_min FROM m WINDOW w AS (PARTITION BY conversation ORDER BY date, ord))"
SES = f"{GAP}, z AS (SELECT *, CAST(sum(CASE WHEN gap_min IS NULL OR gap_min > 480 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation ORDER BY date, ord) AS BIGINT) AS session FROM g)"


@query(f"WITH {GAP} SELECT conversation, ord, round(gap_min, 4) AS gap_min FROM g")
def w1_gap(spark, sf):
    return W.with_gap(messages(spark, sf)).select("conversation", "ord", F.round("gap_min", 4).alias("gap_min"))


@query(f"WITH {GAP} SELECT conversation, ord, round(avg(gap_min) OVER (PARTITION BY conversation ORDER BY date, ord ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS tempo_min FROM g")
def w2_tempo(spark, sf):
    return W.with_tempo(W.with_gap(messages(spark, sf))).select("conversation", "ord", F.round("tempo_min", 4).alias("tempo_min"))


@query(f"WITH {SES} SELECT conversation, ord, session FROM z")
def w3_sessions(spark, sf):
    return W.with_session(messages(spark, sf)).select("conversation", "ord", "session")


@query(f"""WITH {SES}, l AS (SELECT *, sender_name || ': ' || text AS line FROM z), p AS (SELECT *, lag(line, 1) OVER w AS p1, lag(line, 2) OVER w AS p2, row_number() OVER (PARTITION BY conversation, session ORDER BY date, ord) AS r FROM l WINDOW w AS (PARTITION BY conversation ORDER BY date, ord))
SELECT conversation, session, coalesce('[CONTEXT] ' || max(CASE WHEN r = 1 THEN p2 END) || chr(10), '') || coalesce('[CONTEXT] ' || max(CASE WHEN r = 1 THEN p1 END) || chr(10), '') || string_agg(line, chr(10) ORDER BY date, ord) AS text, min(date) AS date, CAST(count(*) AS INT) AS message_count FROM p GROUP BY conversation, session""")
def w4_session_documents(spark, sf):
    return W.session_documents(messages(spark, sf))


@query(f"WITH {M} SELECT conversation, ord, round(coalesce(value - lag(value) OVER w, 0), 6) AS delta FROM m WINDOW w AS (PARTITION BY conversation ORDER BY date, ord)")
def w5_delta(spark, sf):
    return messages(spark, sf).select("conversation", "ord", F.round(W.delta("value", "conversation", "date", "ord"), 6).alias("delta"))


@query(f"WITH {M} SELECT conversation, ord, round(sum(value) OVER (PARTITION BY conversation ORDER BY date, ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM m")
def w6_smooth(spark, sf):
    return messages(spark, sf).select("conversation", "ord", F.round(W.smooth("value", "conversation", 3, "date", "ord"), 6).alias("smooth"))


@query(f"WITH {M} SELECT conversation, ord, date AS since, lead(date) OVER (PARTITION BY conversation ORDER BY date, ord) AS until FROM m WHERE sender_name = 'purchase'")
def w7_until_next(spark, sf):
    return messages(spark, sf).filter("sender_name = 'purchase'").select("conversation", "ord", F.col("date").alias("since"), W.until_next("date", "conversation", "date", "ord").alias("until"))


@query("SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' [SEP] ') AS context FROM conversations")
def w8_context_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", W.context_text("text", "conv_id", 3, "turn").alias("context"))


@query("SELECT * FROM (SELECT conv_id, turn, role, coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)), '') AS context, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r > 1")
def w9_model_context(spark, sf):
    x = table(spark, sf, "conversations")
    rows = W.context_rows(["role", "text"], "conv_id", 3, "turn")
    x = x.select("conv_id", "turn", "role", F.array_join(F.transform(rows, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("context"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("r"))
    return x.filter("r > 1")


@query("""WITH f AS (SELECT user_id, ts, value / 100 AS lat, value / 50 AS lng FROM events WHERE value IS NOT NULL), c AS (SELECT *, CAST(round_even(lat / 0.5, 0) AS BIGINT) || '_' || CAST(round_even(lng / 0.5, 0) AS BIGINT) AS cell FROM f),
n AS (SELECT *, CASE WHEN lag(cell) OVER w IS NULL OR cell <> lag(cell) OVER w OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 72 * 3600e6 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, lat, lng)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, lat, lng) AS stay FROM n)
SELECT user_id, cell, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n FROM s GROUP BY user_id, stay, cell HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 300 * 1e6""")
def w10_stay_points(spark, sf):
    e = table(spark, sf, "events").filter("value is not null").select("user_id", "ts", (F.col("value") / 100).alias("lat"), (F.col("value") / 50).alias("lng"))
    return W.stay_points(e, "user_id", "ts", "lat", "lng", gap_h=72, step=0.5).select("user_id", "cell", "start_time", "end_time", "n")


@query("SELECT 'window_' || (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS id, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def w13_ordinal_ids(spark, sf):
    return W.with_ordinal_id(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "window_").select("id", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


# --- text functions


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def p1_dates(spark, sf):
    x = table(spark, sf, "orders")
    shown = lambda f: F.date_format("o_orderdate", f)
    return x.select("o_orderkey", F.date_format(T.chat_timestamp(shown("MMM d, yyyy h:mm:ss a")), "yyyy-MM-dd HH:mm:ss").alias("ts"), T.partial_date(shown("MMM yyyy")).alias("month"), T.day_month_year(shown("dd MMM yyyy")).alias("day"))


STRIP = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {STRIP("left(t, length(t) // 2)")} AS a, {STRIP("substr(t, length(t) // 2 + 1)")} AS b, {STRIP("t")} AS bare FROM documents)
SELECT doc_id, CASE WHEN length(t) < 6 OR a <> b THEN t ELSE a END AS kept, CASE WHEN length(t) < 3 THEN t || chr(10) || t ELSE bare END AS once, CASE WHEN length(bare) >= 2 THEN bare ELSE {STRIP("t || ' 😆Ann'")} END AS before FROM d""")
def p5_whole_texts(spark, sf):
    x = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    said = F.concat("text", F.lit(" \U0001f606Ann"))
    return x.select("doc_id", T.reaction_duplicate("text").alias("kept"), T.reaction_duplicate(F.concat("text", F.lit("\n"), "text")).alias("once"), T.reaction_duplicate(F.concat(said, F.lit(" "), said)).alias("before"))


TYPE = lambda c: f"CASE WHEN regexp_matches({c}, {s('(?i)^(?:' + '|'.join(V.SYSTEM_STARTS) + ')')}) THEN 'system' WHEN regexp_matches({c}, {s('(?i)^(?:' + '|'.join(V.REACTION_STARTS) + ')')}) THEN 'reaction' ELSE 'text' END"
SAID = "CASE event_id % 7 WHEN 0 THEN 'You called ' || event_type WHEN 1 THEN 'You reacted to ' || event_type WHEN 2 THEN 'Anna joined the video call' WHEN 3 THEN 'so excited about my new job' WHEN 4 THEN 'see https://x.example/' || event_id || ' (edited)' WHEN 5 THEN 'ok' ELSE 'I moved to Paris and live in a house, sorry for the bad news' END"


def said(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr(SAID).alias("said"))


@query(f"SELECT type, count(*) AS n FROM (SELECT {TYPE('said')} AS type FROM (SELECT {SAID} AS said FROM events)) GROUP BY type")
def p6_message_type(spark, sf):
    return said(spark, sf).groupBy(T.message_type("said").alias("type")).agg(F.count("*").alias("n"))


NOTICE = ["Anna Lee named the group Trip to Rome.", "Anna Lee added Bob Ray to the group.", "Bob left the group.", "Anna set your nickname to Big.", "Anna set the emoji to X.", "Anna pinned a message.", "Anna started a video call.", "Anna sent a live location.", "Anna Lee removed Bob from the group.", "Download file: a/b/c.pdf", "https://x.example/a?b", "\U0001f602Anna Lee (Jul 06, 2023 8:10:32 pm)", "\u2764Bob"]
SENT = "coalesce(text, '') || ' so ' || CASE (conv_id + turn) % 13 " + " ".join(f"WHEN {i} THEN {s(n)}" for i, n in enumerate(NOTICE)) + " END || ' then (edited)'"


@query("SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) || CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN '' ELSE ' ' END || CASE (conv_id + turn) % 13 WHEN 3 THEN 'so' ELSE 'so then' END AS clean FROM conversations")
def p8_training_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.training_text(F.expr(SENT)).alias("clean"))


TYPES = [*V.ACTIVITIES, "Foo_Bar", "Row"]


@query(f"SELECT event_id, CASE kind {' '.join(f'WHEN {s(k)} THEN {s(v)}' for k, v in V.ACTIVITIES.items())} ELSE lower(replace(kind, '_', ' ')) END AS name FROM (SELECT event_id, [{', '.join(map(s, TYPES))}][event_id % {len(TYPES)} + 1] AS kind FROM events)")
def p15_activities(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % len(TYPES) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.activity_name(kind).alias("name"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, trim(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '\\s{2,}', ' ', 'g')) AS plain FROM documents")
def p11_p12_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").cast("long").alias("words"), T.language_text("text").alias("plain"))


DEV = "CASE c_custkey % 6 WHEN 0 THEN 'Android OS 6.0.1 API 23 (samsung, X)' WHEN 1 THEN 'iOS 12' WHEN 2 THEN 'web_player osx' WHEN 3 THEN 'OS X 10' WHEN 4 THEN '' ELSE 'Partner lg' END"


@query(f"SELECT device, count(*) AS n FROM (SELECT CASE {DEV} WHEN 'Android OS 6.0.1 API 23 (samsung, X)' THEN 'Android (Samsung)' WHEN 'iOS 12' THEN 'iOS' WHEN 'web_player osx' THEN 'Web Player' WHEN 'OS X 10' THEN 'macOS' WHEN '' THEN 'Unknown' ELSE 'Smart TV' END AS device FROM customer) GROUP BY device")
def p14_devices(spark, sf):
    return table(spark, sf, "customer").select(T.device(F.expr(DEV)).alias("device")).groupBy("device").agg(F.count("*").alias("n"))


@query("SELECT CAST(round_even(value / 0.01, 0) AS BIGINT) AS cell, count(*) AS visits FROM events GROUP BY 1 HAVING count(*) >= 5")
def p16_f13_grid(spark, sf):
    return table(spark, sf, "events").groupBy(T.grid_cell("value").alias("cell")).agg(F.count("*").alias("visits")).filter("visits >= 5")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN 'Unknown City' ELSE 'City' || s_nationkey END AS city, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p17_address(spark, sf):
    x = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    shapes = ["1 Street, City%d, Some Region, 12345, %s", "City%d, %s", "%2$s", " 5 Lane,, City%d , County Down , %s"]
    made = F.get(F.array(*[F.format_string(p, "s_nationkey", "n_name") for p in shapes]), (F.col("s_suppkey") % 4).cast("int"))
    a = T.address(made)
    return x.select("s_suppkey", a.alias("a")).select("s_suppkey", "a.city", "a.country")


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS slug, left(p_name, 8) AS short FROM part")
def p25_p33_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug("p_name").alias("slug"), T.shorten("p_name", 8).alias("short"))


TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {any_of('text', k)} THEN {s(t)} END" for t, k in V.INTERESTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({TOPICS}, ',') AS topics FROM documents")
def p26_topics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.topics("text"), ",").alias("topics"))


IMP = f"greatest({V.IMPORTANCE_BASE}, " + ", ".join(f"CASE WHEN contains(lower(said), {s(k)}) THEN {w} ELSE {V.IMPORTANCE_BASE} END" for k, w in V.IMPORTANCE.items()) + ")"
EMO = "CASE " + " ".join(f"WHEN {any_of('said', k)} THEN {s(e)}" for e, k in V.EMOTION_WORDS.items()) + " ELSE 'neutral' END"


@query(f"SELECT event_id, CAST({IMP} AS DOUBLE) AS importance, {EMO} AS emotion FROM (SELECT event_id, {SAID} AS said FROM events) WHERE {IMP} > 0.3")
def p26_f15_episodes(spark, sf):
    return said(spark, sf).select("event_id", T.importance("said").alias("importance"), T.emotion_word("said").alias("emotion")).filter("importance > 0.3")


OCC = lambda c, k: f"((length({c}) - length(replace({c}, {s(k)}, ''))) // {len(k)})"
REL = {n: " + ".join(OCC("t", k) for k in ks) for n, ks in V.RELATION_WORDS.items()}


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t, n_chars % 100 AS n FROM documents), r AS (SELECT doc_id, n, {REL['PARTNER']} AS p, {REL['FAMILY']} AS f, {REL['COLLEAGUE']} AS c FROM d), b AS (SELECT *, greatest(p, f, c) AS best FROM r)
SELECT doc_id, CASE WHEN best < 2 THEN CASE WHEN n > 50 THEN 'FRIEND_OF' ELSE 'MET' END WHEN p = best THEN 'PARTNER_OF' WHEN f = best THEN 'FAMILY_OF' ELSE 'COLLEAGUE_OF' END AS relation, round(CASE WHEN best < 2 THEN CASE WHEN n > 50 THEN least(0.4 + n / 1000, 0.9) ELSE 0.5 END ELSE least(0.3 + 0.1 * best + n / 5000, 0.95) END, 6) AS confidence FROM b""")
def p28_relations(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 100).alias("n"), T.relation_scores("text").alias("sc"))
    r = T.classify_relation("sc", "n")
    return x.select("doc_id", r["relation"].alias("relation"), F.round(r["confidence"], 6).alias("confidence"))


@query("SELECT event_id, round(least(greatest(value / 50 - 1, -1), 1), 6) AS v, CAST(0.5 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS d FROM events WHERE value IS NOT NULL")
def p29_model_json(spark, sf):
    x = table(spark, sf, "events").filter("value is not null").withColumn("raw", F.concat(F.lit('Sure: {"v": '), (F.col("value") / 50 - 1).cast("string"), F.lit(', "d": 7} done')))
    r = T.vad_reply("raw")
    return x.select("event_id", F.round(r["v"], 6).alias("v"), r["a"].alias("a"), r["d"].alias("d"))


@query("SELECT doc_id, (length(text) + length(lang || source) + length(source) + 4 * 256) // 3 AS tokens FROM documents")
def p22_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate("text", F.concat("lang", "source"), "source", 256).cast("long").alias("tokens"))


@query("SELECT doc_id, trim(coalesce(text, ''), ' ') AS thought, trim('answer ' || coalesce(text, ''), ' ') AS answer FROM documents")
def p23_whole_texts(spark, sf):
    x = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    r = T.think_split(F.concat(F.lit("<think>"), "text", F.lit("</think> answer "), "text"))
    return x.select("doc_id", r["thought"].alias("thought"), r["answer"].alias("answer"))


LOWQ = "(?i)^(?:" + "|".join(V.STOCK) + ")$"


@query(f"SELECT event_id, regexp_matches(said, {s('(?i)(?:' + ')|(?:'.join(V.NOISE) + ')')}) AS noise, (trim(said) = '' OR regexp_matches(trim(said), {s(LOWQ)}) OR regexp_matches(said, {s('(?i)(?:' + ')|(?:'.join(V.ARTEFACTS) + ')')}) OR len(list_filter(regexp_split_to_array(said, '\\s+'), lambda x: x <> '')) < 2) AS low FROM (SELECT event_id, {SAID} AS said FROM events)")
def f4_f6_quality(spark, sf):
    return said(spark, sf).select("event_id", T.is_noise("said").alias("noise"), T.is_low_quality("said").alias("low"))


# --- emotions: the value of an event as a distribution

PROBS = "coalesce(value, 0) AS x FROM events"
RAW = {"anger": "x % 7", "disgust": "x % 3", "fear": "x % 5", "joy": "x % 11", "surprise": "x % 2", "sad": "x % 13", "neutral": "x % 4"}
FIVE = {"anger": "x % 7 + x % 3", "fear": "x % 5", "joy": "x % 11 + x % 2", "sadness": "x % 13", "neutral": "x % 4"}
TOTAL = " + ".join(FIVE.values())
HARM = f"h AS (SELECT event_id, user_id, ts, " + ", ".join(f"CASE WHEN {TOTAL} > 0 THEN ({v}) / ({TOTAL}) ELSE 0 END AS {e}" for e, v in FIVE.items()) + f" FROM (SELECT event_id, user_id, ts, floor(abs({PROBS.split(' AS ')[0]})) AS x FROM events))"
VADS = "v AS (SELECT *, " + ", ".join(" + ".join(f"{e} * {E.VAD[e][k]}" for e in V.EMOTIONS) + f" AS {n}" for k, n in enumerate("vad")) + " FROM h)"
DOM = "CASE " + " ".join(f"WHEN {e} = greatest({', '.join(V.EMOTIONS)}) THEN '{e}'" for e in V.EMOTIONS) + " END"


def emotions(spark, sf) -> DataFrame:
    x = table(spark, sf, "events").withColumn("x", F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("double"))
    x = x.withColumn("p", F.create_map(*[y for k, v in RAW.items() for y in (F.lit(k), F.expr(v))]))
    x = x.withColumn("e", E.harmonise("p")).withColumn("vad", E.vad("e"))
    return x.select("event_id", "user_id", "ts", "e", E.dominant("e").alias("dominant"), "e.*", "vad.v", "vad.a", "vad.d")


@query(f"WITH {HARM}, {VADS} SELECT event_id, round(v, 6) AS v, round(a, 6) AS a, round(d, 6) AS d, {DOM} AS dominant FROM v")
def p34_p36_emotions(spark, sf):
    return emotions(spark, sf).select("event_id", *[F.round(c, 6).alias(c) for c in "vad"], "dominant")


@query(f"WITH {HARM}, {VADS}, n AS (SELECT {DOM} AS dominant, count(*) AS n FROM v GROUP BY 1) SELECT e AS dominant, coalesce(n, 0) AS n FROM (SELECT unnest({V.EMOTIONS}) AS e) LEFT JOIN n ON e = dominant")
def a23_dominant_counts(spark, sf):
    return A.emotion_counts(emotions(spark, sf).select("dominant"), "dominant")


@query(f"WITH {HARM}, {VADS} SELECT round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(var_pop(v), 6) AS v_var, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max FROM v")
def a21_vad_summary(spark, sf):
    x = A.population(emotions(spark, sf), ["v"])
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@query(f"WITH {HARM}, {VADS}, d AS (SELECT user_id, " + ", ".join(f"coalesce({c} - lag({c}) OVER w, 0) AS {c}_" for c in "vad") + " FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT user_id, sqrt(v_ * v_ + a_ * a_ + d_ * d_) AS s FROM d) SELECT user_id, count(*) AS n, round(avg(s), 2) AS mean_step, round(max(s), 2) AS max_step FROM t GROUP BY user_id HAVING count(*) >= 2")
def a24_drift(spark, sf):
    x = emotions(spark, sf)
    x = x.select("user_id", *[W.delta(c, "user_id", "ts", "event_id").alias(f"d{c}") for c in "vad"])
    step = F.sqrt(F.col("dv") * F.col("dv") + F.col("da") * F.col("da") + F.col("dd") * F.col("dd"))
    exact = x.withColumn("s", step).groupBy("user_id").agg(F.round(F.avg("s"), 2).alias("mean_step"), F.round(F.max("s"), 2).alias("max_step"))
    return A.drift(x, "user_id", ["dv", "da", "dd"]).select("user_id", "n").join(exact, "user_id")


# --- aggregates


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, min(event_id), user_id LIMIT 1")
def a1_most_frequent(spark, sf):
    return A.most_frequent(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "n")


@query("SELECT r_name AS source, coalesce(n, 0) AS n FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE '%1%' GROUP BY 1) ON n_regionkey = r_regionkey")
def a2_source_counts(spark, sf):
    n = table(spark, sf, "nation").filter("n_name like 'A%' or n_name like '%1%'").withColumnRenamed("n_regionkey", "r_regionkey")
    return A.counts_with_zeros(n, "r_regionkey", table(spark, sf, "region")).select(F.col("r_name").alias("source"), "n")


@query("SELECT year, n, round_even(n / max(n) OVER () * 100, 1) AS bar FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1)")
def a3_year_timeline(spark, sf):
    return A.year_timeline(table(spark, sf, "orders"), "o_orderdate")


@query("WITH c AS (SELECT conv_id, count(*) AS c FROM conversations WHERE trim(text) <> '' GROUP BY 1), b AS (SELECT * FROM (VALUES " + ", ".join(f"({lo}, {hi or 10**9}, '{n}')" for lo, hi, n in A.LENGTHS) + ") AS t(lo, hi, bucket)) SELECT bucket, count(conv_id) AS n FROM b LEFT JOIN c ON c BETWEEN lo AND hi GROUP BY bucket")
def a4_length_buckets(spark, sf):
    return A.length_buckets(table(spark, sf, "conversations"), "conv_id", "text")


@query("SELECT count(*) FILTER (value > 30) AS plays, count(DISTINCT CASE WHEN value > 30 THEN event_type || '/' || (event_id % 50) END) AS tracks, count(DISTINCT CASE WHEN value > 30 THEN event_type END) AS artists, count(*) FILTER (NOT coalesce(value > 30, FALSE)) AS skipped FROM events")
def a10_f11_plays(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("artist"), (F.col("event_id") % 50).cast("string").alias("title"), "ts", (F.col("value") * 1000).alias("ms_played"))
    return A.play_summary(e).select("plays", "tracks", "artists", "skipped")


@query("SELECT l_returnflag AS game, CAST(sum(l_quantity) AS BIGINT) AS total_s, count(*) AS sessions, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a12_game_rollup(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("game"), F.col("l_quantity").alias("duration_s"), F.col("l_shipdate").alias("start_at"), F.col("l_shipdate").alias("end_at"))
    return A.session_summary(x, "game").select("game", F.col("total_s").cast("long").alias("total_s"), "sessions", "first", "last")


def _stop(ws, c="text"):
    return f"len(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: list_contains([{', '.join(map(s, ws))}], x)))"


FR = ["le", "la", "les", "des", "est", "une", "que", "pour", "dans", "avec", "pas", "sur"]
EN = ["the", "and", "of", "to", "is", "that", "with", "for", "was", "this", "not", "on"]


@query(f"WITH t AS (SELECT source, {_stop(FR)} > {_stop(EN)} AS fr, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, text) AS r FROM documents WHERE length(text) >= 30) SELECT source, CASE WHEN count(*) FILTER (fr) > count(*) FILTER (NOT fr) THEN 'fr' ELSE 'en' END AS language FROM t WHERE r <= 30 GROUP BY source")
def a13_language_vote(spark, sf):
    from .plans.context import stopword_language

    return A.language_vote(table(spark, sf, "documents"), "source", "text", stopword_language("text") == "fr")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n, min(turn) AS first_date FROM conversations GROUP BY conv_id")
def a14_conversation_text(spark, sf):
    return A.conversation_text(table(spark, sf, "conversations").withColumn("o", F.lit(0)), "conv_id", "turn", "o", "text")


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years, min(o_orderdate) AS since, max(o_orderdate) AS last FROM orders GROUP BY 1 HAVING count(*) >= 2 OR count(DISTINCT year(o_orderdate)) >= 2")
def a15_evidence(spark, sf):
    return A.evidence(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query("SELECT user_id, event_type, count(*) AS n, round(least(0.2 + count(*) / 10, 0.8), 4) AS confidence FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def a16_mentions(spark, sf):
    return A.mentions(table(spark, sf, "events"), ["user_id", "event_type"]).withColumn("confidence", F.round("confidence", 4))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT CAST(least(19, greatest(0, ceil((value - lo) / (hi - lo) * 20) - 1)) AS INT) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1) SELECT CAST(i AS INT) AS bin, round(lo + (i + 0.5) * (hi - lo) / 20, 6) AS mid, coalesce(n, 0) AS n FROM range(20) AS r(i) CROSS JOIN b LEFT JOIN c ON bin = i")
def a22_histogram(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value").withColumn("mid", F.round("mid", 6))


@query("SELECT source, n, round_even(n / sum(n) OVER () * 100, 1) AS pct FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def w14_share(spark, sf):
    return A.share(table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")))


@query("SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def a31_languages(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("WITH p AS (SELECT split(regexp_replace(regexp_replace(url, '^[a-z]+:/*', ''), '[?#].*$', ''), '/') AS p FROM pages WHERE url IS NOT NULL), f AS (SELECT array_to_string(p[1:k], '/') AS folder, k = len(p) - 1 AS own FROM p, unnest(range(1, len(p))) AS u(k)) SELECT folder, count(*) AS files, count(*) FILTER (own) AS own_files FROM f GROUP BY folder")
def a32_folders(spark, sf):
    p = table(spark, sf, "pages").filter("url is not null").select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return A.files_by_folder(p.filter(F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")) > 1))


# --- joins


@query("SELECT c_custkey, coalesce(n_name, 'nation ' || c_nationkey) AS place FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def j1_j3_lookup(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey % 2 = 0")
    return J.lookup(table(spark, sf, "customer"), "c_nationkey", n, "n_nationkey", "n_name", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), "place").select("c_custkey", "place")


@query("SELECT o_orderkey, arg_min(s_suppkey, l_linenumber * 1000000 + s_suppkey) AS supplier FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 5000 GROUP BY o_orderkey")
def j2_first_match(spark, sf):
    people = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("pos"), F.col("l_suppkey").cast("string").alias("name"))
    dim = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_suppkey").alias("conversation"))
    return J.first_match(people, dim).select(F.col("q").alias("o_orderkey"), F.col("conversation").alias("supplier"))


@query("SELECT DISTINCT c_custkey, format('{:.6f}_{:.6f}', c_acctbal, c_acctbal / 2) AS cell FROM customer")
def j4_coordinate_key(spark, sf):
    x = table(spark, sf, "customer").withColumn("h", F.col("c_acctbal") / 2)
    return x.select("c_custkey", J.coordinate_key("c_acctbal", "h").alias("cell"))


@query("SELECT c_custkey, s.s_suppkey AS colleague FROM customer JOIN (SELECT s_nationkey, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def j5_colleagues(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("company"))
    own = table(spark, sf, "supplier").select(F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string")).alias("company"), F.col("s_suppkey").alias("seq"))
    last = J.last_wins(own, F.lower("company"), "seq", "seq", "k")
    return J.same_company(people, own, "seq").select("c_custkey", F.lower("own_company").alias("k")).join(last, "k").select("c_custkey", F.col("seq").alias("colleague"))


@query("""WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT array_to_string(string_split(p_name, ' ')[1:p_size % 4 + 1], ' ') || CASE WHEN p_size % 5 = 0 THEN 'er' ELSE '' END AS match, min(p_partkey) AS pos FROM part GROUP BY 1), j AS (SELECT name, match, least(length(name), length(match)) AS l, pos FROM a JOIN b ON (starts_with(name, match) OR starts_with(match, name)) WHERE length(name) >= 5 AND length(match) >= 5)
SELECT name, match FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY l DESC, pos) AS r FROM j) WHERE r = 1""")
def j6_prefix_match(spark, sf):
    p = table(spark, sf, "part")
    short = F.concat(F.array_join(F.slice(F.split("p_name", " "), 1, F.col("p_size") % 4 + 1), " "), F.when(F.col("p_size") % 5 == 0, "er").otherwise(""))
    return J.prefix_match(p.select(F.col("p_name").alias("name")).distinct(), p.select(short.alias("name"), F.col("p_partkey").alias("pos")))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def j12_semi(spark, sf):
    keys = table(spark, sf, "customer").filter("c_acctbal > 5000").withColumnRenamed("c_custkey", "o_custkey")
    return J.having(table(spark, sf, "orders"), keys, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13_anti(spark, sf):
    return J.having(table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", present=False).select("c_custkey")


@query("SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def j15_zip(spark, sf):
    return J.zip_rows(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", "quality")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def t6_longest(spark, sf):
    return J.top_per(table(spark, sf, "documents"), ["source"], 3, F.desc("n_chars"), "doc_id").select("source", "doc_id", "n_chars")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def u1_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return J.union_all(c, table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, r_name FROM region")
def u6_right_wins(spark, sf):
    return J.right_wins(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "id")


# --- search

ASK = "theat erand onin thea"
TOK = "t AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents)"
BM = f"""{TOK}, tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), dl AS (SELECT id, count(*) AS dl FROM t GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i),
sc AS (SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN idf USING (term) JOIN dl USING (id), st WHERE term IN ({', '.join(map(s, ASK.split()))}) GROUP BY id),
bm AS (SELECT doc_id AS id, coalesce(score, 0) AS score FROM documents LEFT JOIN sc ON id = doc_id)"""


def corpus(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "n_chars")
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


@query(f"WITH {BM} SELECT id, round(score, 5) AS score FROM bm ORDER BY score DESC, id LIMIT 20")
def v3_bm25(spark, sf):
    d = table(spark, sf, "documents")
    return S.top(S.bm25(d, ASK, "doc_id"), 20, F.desc("score"), "id").select("id", F.round("score", 5).alias("score"))


def keyword_index(spark, sf) -> KeywordIndex:
    """All documents, English ones first, then the others as an append."""
    d, index = table(spark, sf, "documents"), KeywordIndex(spark, shared_folder(spark, "words"), 16)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(d.filter(english), "doc_id")
    index.add(d.filter(~english), "doc_id")
    return index


@query(f"WITH {BM} SELECT id, round(score, 5) AS score FROM bm ORDER BY score DESC, id LIMIT 20")
def v3_bm25_index(spark, sf):
    return keyword_index(spark, sf).search(ASK, 20).select("id", F.round("score", 5).alias("score"))


ASKED = [((i * 37) % 11 - 5) / 5 for i in range(64)]
QV = "[" + ", ".join(f"{x}::DOUBLE" for x in ASKED) + "]"
DIST = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {QV}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"SELECT vec_id, label, round({DIST}, 5) AS distance FROM embeddings ORDER BY {DIST}, vec_id LIMIT 10")
def v2_knn(spark, sf):
    return S.knn(table(spark, sf, "embeddings"), ASKED, 10, "vec_id").select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, label, round({DIST}, 5) AS distance FROM embeddings WHERE label = 3 ORDER BY {DIST}, vec_id LIMIT 10")
def v2_knn_filtered(spark, sf):
    return S.knn(table(spark, sf, "embeddings"), ASKED, 10, "vec_id", condition=F.col("label") == 3).select("vec_id", "label", F.round("distance", 5).alias("distance"))


def vector_index(spark, sf) -> VectorIndex:
    """All vectors, those of the first labels first; each batch once more, as a batch that a failed job repeats."""
    e, index = table(spark, sf, "embeddings"), VectorIndex(spark, shared_folder(spark, "vectors"), 16, "vec_id")
    for k, part in enumerate((e.filter("label < 5"), e.filter("label >= 5 or label is null"))):
        for _ in range(2):
            index.upsert(part, "embeddings", k)
    return index


@query(f"SELECT vec_id, label, round({DIST}, 5) AS distance FROM embeddings ORDER BY {DIST}, vec_id LIMIT 10")
def v2_knn_index(spark, sf):
    return vector_index(spark, sf).search(ASKED, 10).select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, label, round({DIST}, 5) AS distance FROM embeddings WHERE label = 3 ORDER BY {DIST}, vec_id LIMIT 10")
def v2_knn_index_filtered(spark, sf):
    return vector_index(spark, sf).search(ASKED, 10, F.col("label") == 3).select("vec_id", "label", F.round("distance", 5).alias("distance"))


@query("SELECT vec_id, CASE WHEN label = 3 THEN 103 ELSE label END AS label, round(CASE WHEN label = 3 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def k3_vector_upsert(spark, sf):
    index = vector_index(spark, sf)
    turned = table(spark, sf, "embeddings").filter("label = 3").withColumns({"label": F.lit(103), "embedding": F.transform("embedding", lambda x: -x)})
    index.upsert(turned)
    return index.store.read("vectors").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


FUSE = f"""{BM}, c AS (SELECT doc_id AS id, text AS content, source, embedding FROM documents JOIN embeddings ON doc_id = vec_id), sem AS (SELECT content, row_number() OVER (ORDER BY {DIST}, id) AS pos FROM c QUALIFY pos <= 20), kw AS (SELECT content, row_number() OVER (ORDER BY score DESC, c.id) AS pos FROM c JOIN bm ON c.id = bm.id QUALIFY pos <= 20),
se AS (SELECT content, max(pos) AS semantic_rank, min(pos) AS s_pos FROM sem GROUP BY 1), ke AS (SELECT content, max(pos) AS bm25_rank, min(pos) AS b_pos FROM kw GROUP BY 1), fu AS (SELECT coalesce(se.content, ke.content) AS content, semantic_rank, bm25_rank, coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + bm25_rank), 0) AS rrf_score, s_pos, b_pos FROM se FULL JOIN ke ON se.content = ke.content)"""


@query(f"WITH {FUSE} SELECT md5(content) AS content, semantic_rank, bm25_rank, round(rrf_score, 8) AS rrf_score FROM fu")
def v4_rank_fusion(spark, sf):
    c = corpus(spark, sf)
    sem = S.ranked(c.withColumn("distance", S.distance("embedding", ASKED)).select("id", "content", "distance"), "distance", "id", n=20)
    key = S.ranked(c.select("id", "content").join(S.bm25(table(spark, sf, "documents"), ASK, "doc_id"), "id"), F.desc("score"), "id", n=20)
    return S.fuse(sem, key).select(F.md5("content").alias("content"), F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("rrf_score", 8).alias("rrf_score"))


OV = f"len(list_intersect(regexp_split_to_array(lower(content), '\\s+'), [{', '.join(map(s, sorted(set(ASK.split()))))}])) / {len(set(ASK.split()))}"


HELD = FUSE.replace(BM, "docs AS (SELECT documents.* FROM documents JOIN embeddings ON doc_id = vec_id), " + BM.replace("FROM documents", "FROM docs"))


@query(f"WITH {HELD}, best AS (SELECT * FROM fu ORDER BY rrf_score DESC, s_pos NULLS LAST, b_pos NULLS LAST LIMIT 20) SELECT md5(content) AS content, semantic_rank, bm25_rank, round(rrf_score, 8) AS rrf_score, CAST({OV} AS DOUBLE) AS rerank_score FROM best ORDER BY {OV} DESC, rrf_score DESC, s_pos NULLS LAST, b_pos NULLS LAST LIMIT 5")
def v6_hybrid(spark, sf):
    x = S.hybrid(corpus(spark, sf), ASK, ASKED, 20, 5)
    return x.select(F.md5("content").alias("content"), F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("rrf_score", 8).alias("rrf_score"), F.col("rerank_score").cast("double").alias("rerank_score"))


WORDS_OF = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda x: x <> '')"


ASKED_ALL = f"""WITH t AS (SELECT doc_id AS id, {WORDS_OF('text')} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), f AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
d AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM f, n GROUP BY term, n), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM d),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({WORDS_OF('text')}) AS term FROM benchmark) GROUP BY ALL)
SELECT item_id AS query, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)) * c), 4) AS score FROM f JOIN q USING (term) JOIN i USING (term), n GROUP BY 1, 2"""


@query(ASKED_ALL)
def j14_question_table(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return S.bm25_many(d, q).select("query", "id", F.round("score", 4).alias("score"))


@query(f"SELECT query, id, score FROM ({ASKED_ALL.replace(', 4) AS score', ', 6) AS score')}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def j14_top_documents(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return keyword_index(spark, sf).search_many(q, 10)


# --- graph: customers, orders, parts, nations

NONE = "MAP {}"


def edges(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("since", F.date_format("o_orderdate", "yyyy-MM-dd"))
    placed = G.triples(o, [("Person", "o_custkey", "PLACED", "Order", "o_orderkey", {"since": "since"})])
    lives = G.triples(table(spark, sf, "customer"), [("Person", "c_custkey", "LIVES_IN", "Country", "c_nationkey", {})])
    region = G.triples(table(spark, sf, "nation"), [("Country", "n_nationkey", "IN_REGION", "Region", "n_regionkey", {})])
    return placed.unionByName(lives).unionByName(region)


ED = "e AS (SELECT 'Person' AS from_label, o_custkey::VARCHAR AS from_name, 'PLACED' AS rel_type, 'Order' AS to_label, o_orderkey::VARCHAR AS to_name FROM orders UNION ALL SELECT 'Person', c_custkey::VARCHAR, 'LIVES_IN', 'Country', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'Country', n_nationkey::VARCHAR, 'IN_REGION', 'Region', n_regionkey::VARCHAR FROM nation)"
BOTH = f"{ED}, b AS (SELECT * FROM e UNION ALL SELECT to_label, to_name, rel_type, from_label, from_name FROM e WHERE NOT (from_label = to_label AND from_name = to_name))"


@query(f"WITH {ED} SELECT * FROM e")
def g3_triples(spark, sf):
    return edges(spark, sf).select(*G.EDGE)


@query(f"WITH {ED}, n AS (SELECT from_label AS label, from_name AS name FROM e UNION SELECT to_label, to_name FROM e) SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM e GROUP BY 2")
def a6_graph_stats(spark, sf):
    e = edges(spark, sf)
    return G.stats(G.endpoints(e), e)


@query(f"WITH {BOTH} SELECT label, name, degree FROM (SELECT from_label AS label, from_name AS name, count(*) AS degree FROM b GROUP BY 1, 2) ORDER BY degree DESC, label, name LIMIT 10")
def a7_degree(spark, sf):
    e = edges(spark, sf)
    return G.degree(G.endpoints(e), e).orderBy(F.desc("degree"), "label", "name").limit(10)


@query(f"WITH {BOTH} SELECT rel_type, to_label, to_name FROM b WHERE from_name = '3' ORDER BY 1, 2, 3 LIMIT 50")
def t8_neighbours(spark, sf):
    return G.neighbours(edges(spark, sf), "3")


@query(f"WITH {ED} SELECT from_name, to_name FROM e WHERE from_label = 'Person' AND rel_type = 'LIVES_IN'")
def j9_typed(spark, sf):
    return G.typed(edges(spark, sf), "Person", "LIVES_IN", "Country").select("from_name", "to_name")


def measured_edges(spark, sf) -> DataFrame:
    """Users with counted activities and plays, and plain interests."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("topic", F.concat(F.lit("topic "), "event_type"))
    return G.triples(e, [("Person", "user_id", "INTERESTED_IN", "Activity", "event_type", {"activity_count": "n"}), ("Person", "user_id", "INTERESTED_IN", "Interest", "topic", {}), ("Person", "user_id", "LISTENED_TO", "Artist", "event_type", {"play_count": "n"})])


AG = "g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {AG} SELECT 'node' AS kind, 'Person' AS name, count(DISTINCT user_id) AS n FROM g UNION ALL SELECT 'node', 'Activity', CAST(sum(n) AS BIGINT) FROM g UNION ALL SELECT 'node', 'Artist', count(DISTINCT event_type) FROM g UNION ALL SELECT 'node', 'Interest', 2 * count(DISTINCT event_type) FROM g UNION ALL SELECT 'edge', 'INTERESTED_IN', 2 * count(*) FROM g UNION ALL SELECT 'edge', 'LISTENED_TO', count(*) FROM g")
def a6_label_stats(spark, sf):
    e = measured_edges(spark, sf)
    return G.stats(G.endpoints(e), e)


@query(f"WITH {AG} SELECT 'Person' AS label, user_id::VARCHAR AS name, 3 * count(*) AS degree FROM g GROUP BY 2 UNION ALL SELECT 'Activity', event_type, CAST(sum(n) AS BIGINT) FROM g GROUP BY 2 UNION ALL SELECT 'Artist', event_type, CAST(sum(n) AS BIGINT) FROM g GROUP BY 2 UNION ALL SELECT 'Interest', 'topic ' || event_type, count(*) FROM g GROUP BY 2")
def a7_label_degree(spark, sf):
    e = measured_edges(spark, sf)
    return G.degree(G.endpoints(e), e)


@query("SELECT 'edge' AS kind, n_nationkey::VARCHAR AS a, n_regionkey::VARCHAR AS b FROM nation UNION ALL SELECT 'edge', '3', '99' UNION ALL SELECT 'node', 'Country', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'node', 'Region', '99'")
def g4_manual_entry(spark, sf):
    e = edges(spark, sf).filter("rel_type = 'IN_REGION'")
    more = G.add_edge(e, "Country", " 3 ", "IN_REGION", "Region", "99").select(F.lit("edge").alias("kind"), F.col("from_name").alias("a"), F.col("to_name").alias("b"))
    nodes = table(spark, sf, "nation").select(F.lit("Country").alias("label"), F.col("n_nationkey").cast("string").alias("name"), F.create_map().cast("map<string,string>").alias("props"))
    return more.unionByName(G.add_node(nodes, "Region", " 99").select(F.lit("node").alias("kind"), F.col("label").alias("a"), F.col("name").alias("b")))


@query("SELECT p_brand AS to_name, round(sum(l_quantity), 2) AS weight, round_even(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 100, 1) AS pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a8_interest_profile(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("to_name"), F.col("l_quantity").alias("weight"))
    return G.interest_profile(x).withColumn("weight", F.round("weight", 2))


@query("SELECT 'Part' AS label, p_name AS name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'a') ORDER BY name LIMIT 20")
def t7_search_nodes(spark, sf):
    return G.search_nodes(table(spark, sf, "part").select(F.lit("Part").alias("label"), F.col("p_name").alias("name")).distinct(), "A")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || '/' || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_order, arg_max(o_orderkey, o_orderdate::VARCHAR || '/' || lpad(o_orderkey::VARCHAR, 12, '0')) AS last_order FROM orders GROUP BY 1")
def k8_k9_upserts(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", F.col("o_orderkey").alias("k")).alias("seq"))
    return G.upsert(o, ["o_custkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order")).join(G.upsert(o, ["o_custkey"], first_wins=False).select("o_custkey", F.col("o_orderkey").alias("last_order")), "o_custkey")


@query("SELECT user_id AS name, arg_max(event_type, event_id) AS last_type, arg_max(event_id, event_id) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY 1")
def k5_merge_nodes(spark, sf):
    e = table(spark, sf, "events")
    props = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("type"), F.col("event_type"), F.lit("purchase"), F.col("event_id").cast("string"))).otherwise(F.create_map(F.lit("type"), F.col("event_type")))
    rows = e.select(F.lit("Person").alias("label"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("name"), props.alias("props"), F.col("event_id").alias("seq"))
    return G.merge_nodes(rows).select(F.col("name").cast("long").alias("name"), F.col("props")["type"].alias("last_type"), F.col("props")["purchase"].cast("long").alias("last_purchase"))


K6 = "x AS (SELECT user_id::VARCHAR AS f, event_type AS t, CASE WHEN value > 50 THEN strftime(ts, '%Y-%m') ELSE '' END AS since FROM events), dated AS (SELECT DISTINCT * FROM x WHERE since <> '')"


@query(f"WITH {K6} SELECT f AS from_name, t AS to_name, since FROM dated UNION SELECT f, t, '' FROM x WHERE since = '' AND NOT EXISTS (SELECT 1 FROM dated d WHERE d.f = x.f AND d.t = x.t)")
def k6_merge_edges(spark, sf):
    e = table(spark, sf, "events")
    props = F.when(F.col("value") > 50, F.create_map(F.lit("since"), F.date_format("ts", "yyyy-MM"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = e.select(F.lit("Person").alias("from_label"), F.col("user_id").cast("string").alias("from_name"), F.lit("DID").alias("rel_type"), F.lit("Activity").alias("to_label"), F.col("event_type").alias("to_name"), props.alias("props"), F.col("event_id").alias("seq"))
    return G.merge_edges(rows).select("from_name", "to_name", "since")


def event_graph(spark, sf) -> GraphStore:
    """Users and what they did, merged in two batches by time, each batch sent twice."""
    e, store = table(spark, sf, "events"), GraphStore(spark, shared_folder(spark, "graph"), 16)
    last = F.create_map(F.lit("last"), F.col("event_id").cast("string"))
    props = F.when(F.col("value") > 50, F.map_concat(last, F.create_map(F.lit("since"), F.date_format("ts", "yyyy-MM")))).otherwise(last)
    person = F.concat(F.lit(" "), F.col("user_id").cast("string"))
    rows = e.select(F.lit("Person").alias("from_label"), person.alias("from_name"), F.lit("DID").alias("rel_type"), F.lit("Activity").alias("to_label"), F.col("event_type").alias("to_name"), props.alias("props"), F.col("event_id").alias("seq"))
    nodes = e.filter("event_type = 'purchase'").select(F.lit("Person").alias("label"), person.alias("name"), F.create_map(F.lit("purchase"), F.col("event_id").cast("string")).alias("props"), F.col("event_id").alias("seq"))
    half = e.agg(F.avg("event_id")).first()[0] or 0
    for k, now in enumerate((F.col("seq") <= half, F.col("seq") > half)):
        for _ in range(2):
            store.merge(nodes.filter(now), rows.filter(now), "events", k)
    return store


LAST = "x AS (SELECT user_id::VARCHAR AS f, event_type AS t, event_id AS i, CASE WHEN value > 50 THEN strftime(ts, '%Y-%m') ELSE '' END AS since FROM events), dated AS (SELECT DISTINCT f, t, since FROM x WHERE since <> '')"


@query(f"WITH {LAST} SELECT d.f AS from_name, d.t AS to_name, d.since, max(i) AS last FROM dated d JOIN x ON d.f = x.f AND d.t = x.t AND x.since IN (d.since, '') GROUP BY ALL UNION ALL SELECT f, t, '', max(i) FROM x WHERE since = '' AND NOT EXISTS (SELECT 1 FROM dated d WHERE d.f = x.f AND d.t = x.t) GROUP BY ALL")
def k7_stored_edges(spark, sf):
    return event_graph(spark, sf).edges().select("from_name", "to_name", "since", F.col("props")["last"].cast("long").alias("last"))


@query("SELECT 'Person' AS label, user_id::VARCHAR AS name, max(event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id UNION ALL SELECT DISTINCT 'Activity', event_type, NULL FROM events")
def k5_stored_nodes(spark, sf):
    return event_graph(spark, sf).nodes().select("label", "name", F.col("props")["purchase"].cast("long").alias("purchase"))


@query(f"WITH {BOTH} SELECT from_name, rel_type, to_label, to_name FROM b WHERE from_label = 'Country'")
def j8_stored_expansion(spark, sf):
    store = GraphStore(spark, shared_folder(spark, "graph"), 16)
    store.merge(edges=edges(spark, sf).withColumn("seq", F.lit(0)))
    countries = table(spark, sf, "nation").select(F.lit("Country").alias("label"), F.col("n_nationkey").cast("string").alias("name"))
    return store.expand(countries).select("from_name", "rel_type", "to_label", "to_name")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def u2_distinct_triples(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("from_name"), F.lit("DID").alias("rel_type"), F.col("event_type").alias("to_name"), F.create_map().cast("map<string,string>").alias("props"), F.col("event_id").alias("seq"))
    return G.distinct_triples(e).agg(F.count("*").alias("n"))


@query("SELECT c_custkey || ' placed ' || o_orderkey || ' (Order) [since ' || strftime(o_orderdate, '%Y-%m-%d') || ']' AS fact FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey = 7 UNION SELECT c_custkey || ' lives in ' || c_nationkey || ' (Country)' FROM customer WHERE c_custkey = 7")
def g1_facts(spark, sf):
    e = edges(spark, sf).filter("from_label = 'Person'")
    return G.facts(e.filter("from_name = '7' and to_name <> '7'"), ["7"], n=10_000).select("fact")


@query("SELECT l_suppkey AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 5")
def g2_top_skill(spark, sf):
    return G.top_skill(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "key"), "key", F.sum("l_extendedprice")).select("key", F.round("value", 2).alias("value"))


@query("SELECT rel_type, count(*) AS n, count(DISTINCT to_name) AS targets FROM (SELECT 'SENT' AS rel_type, sha256(event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || event_id) AS to_name FROM events UNION ALL SELECT 'IN_CONVERSATION', user_id::VARCHAR FROM events) GROUP BY 1")
def k10_message_graph(spark, sf):
    m = messages(spark, sf).select("sender_name", "date", F.regexp_replace("text", "event ", "").alias("text"), F.col("conversation").cast("string").alias("conversation"))
    return G.message_graph(m).groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("to_name").alias("targets"))


# --- training examples


@query("WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM f) SELECT conv_id, block, role, string_agg(text, ' ' ORDER BY turn) AS text FROM b GROUP BY 1, 2, 3")
def p31_merge_roles(spark, sf):
    return Q.merge_role_rows(table(spark, sf, "conversations"))


PAT = "p AS (SELECT conv_id, string_agg(role, '→' ORDER BY turn) AS pattern, list(role ORDER BY turn) AS roles, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS words FROM conversations GROUP BY 1)"


@query(f"WITH {PAT} SELECT pattern, n, round_even(n / sum(n) OVER () * 100, 1) AS pct FROM (SELECT pattern, count(*) AS n FROM p GROUP BY 1) ORDER BY n DESC, pattern LIMIT 10")
def a27_role_patterns(spark, sf):
    return Q.role_patterns(Q.examples(table(spark, sf, "conversations")))


@query(f"WITH {PAT} SELECT CAST(min(words) AS BIGINT) AS least, CAST(max(words) AS BIGINT) AS most, round(avg(words), 4) AS mean, median(words) AS median, count(*) FILTER (words > 200) AS over FROM p")
def a26_lengths(spark, sf):
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.word_count("text")).alias("words"))
    return Q.length_stats(x, "words", 200).withColumn("mean", F.round("mean", 4))


@query(f"WITH {PAT} SELECT count(*) AS examples, count(*) FILTER (roles[-1] = 'user') AS ends_with_user, count(*) FILTER (len(list_filter(range(1, len(roles)), lambda i: roles[i] = roles[i + 1])) > 0) AS adjacent_same_role, count(*) FILTER (roles[1] = 'system') AS with_system FROM p")
def a28_diagnostics(spark, sf):
    return Q.diagnostics(Q.examples(table(spark, sf, "conversations"))).drop("with_markers")


@query("WITH n AS (SELECT conv_id, turn, role, text AS user, lead(role) OVER w AS r2, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, user, reply FROM n WHERE role = 'user' AND r2 = 'assistant'")
def w12_turn_pairs(spark, sf):
    c = table(spark, sf, "conversations").filter("role <> 'system' or turn > 0").withColumn("own", F.col("role") == "assistant").withColumn("ts", F.timestamp_seconds("turn"))
    b = Q.turn_blocks(c.filter("role in ('user', 'assistant')"), "conv_id", "ts", "turn", "own", "text")
    x = Q.exchanges(b, "conv_id", "own")
    first = b.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.unix_seconds("last_ts").alias("turn"))
    return x.join(first, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "turn", "user", "reply")


TALK = """c AS (SELECT conv_id // 10 AS conv, conv_id * 100 + turn AS ord, TIMESTAMP '2024-01-01' + to_seconds(CAST(conv_id * 7200 + turn * 1000 + length(text) % 1000 AS BIGINT)) AS date, role = 'assistant' AS own, CASE WHEN length(text) % 3 = 0 THEN text || '?' ELSE text END AS text FROM conversations WHERE role <> 'system'),
f AS (SELECT *, CASE WHEN own = lag(own) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY conv ORDER BY date, ord)), n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv ORDER BY date, ord) AS BIGINT) AS block FROM f),
b AS (SELECT conv, block, own, string_agg(text, chr(10) ORDER BY date, ord) AS text, min(date) AS first_ts, max(date) AS last_ts FROM n GROUP BY 1, 2, 3),
x AS (SELECT *, lead(own) OVER w AS o2, lead(text) OVER w AS reply, lead(first_ts) OVER w AS reply_ts FROM b WINDOW w AS (PARTITION BY conv ORDER BY block)),
e AS (SELECT conv, block, text AS q, reply, epoch_us(reply_ts) - epoch_us(last_ts) > 16 * 60e6 AS desync, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda y: y <> '')) > 250 OR len(list_filter(regexp_split_to_array(reply, '\\s+'), lambda y: y <> '')) > 250 AS too_long, reply LIKE '%?' AS asks FROM x WHERE NOT own AND o2)"""


def walk_sql(max_turns: int) -> str:
    """The walk itself, from exchange to exchange."""
    return f"""WITH RECURSIVE {TALK}, g AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY block) AS i FROM e), walk AS (SELECT conv, 0::BIGINT AS i, NULL::BIGINT AS start, 0 AS n, false AS asked FROM (SELECT DISTINCT conv FROM g) UNION ALL
SELECT g.conv, g.i, CASE WHEN desync OR too_long THEN NULL WHEN n = 0 OR n >= {max(3 * max_turns, 10)} OR (n >= {max_turns} AND NOT asked) THEN g.block ELSE start END, CASE WHEN desync OR too_long THEN 0 WHEN n = 0 OR n >= {max(3 * max_turns, 10)} OR (n >= {max_turns} AND NOT asked) THEN 1 ELSE n + 1 END, asks AND NOT (desync OR too_long) FROM walk JOIN g ON g.conv = walk.conv AND g.i = walk.i + 1)
SELECT g.conv, CAST(start AS INT) AS start, CAST(2 * count(*) AS INT) AS n, md5(string_agg('user: ' || q || chr(10) || 'assistant: ' || reply || chr(10), '' ORDER BY g.i)) AS messages FROM walk JOIN g ON g.conv = walk.conv AND g.i = walk.i WHERE start IS NOT NULL GROUP BY 1, 2"""


def talks(spark, sf) -> DataFrame:
    """Ten conversations as one, replies after some minutes, every third message a question."""
    c = table(spark, sf, "conversations").filter("role <> 'system'")
    at = F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("conv_id") * 7200 + F.col("turn") * 1000 + F.length("text") % 1000
    return c.select(F.floor(F.col("conv_id") / 10).alias("conv"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.timestamp_seconds(at).alias("date"), (F.col("role") == "assistant").alias("own"), F.when(F.length("text") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))


def talk_examples(spark, sf, max_turns: int) -> DataFrame:
    x = Q.training_pairs(talks(spark, sf), "conv", "date", "ord", "own", "text", max_turns, 16, 250)
    line = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"))), "")
    return x.select("conv", "start", F.size("messages").alias("n"), F.md5(line).alias("messages"))


@query(walk_sql(1))
def q1_training_pairs(spark, sf):
    return talk_examples(spark, sf, 1)


@query(walk_sql(3))
def q1_longer_examples(spark, sf):
    return talk_examples(spark, sf, 3)


@query(f"WITH {TALK} SELECT conv, count(*) AS exchanges, count(*) FILTER (desync) AS desync, count(*) FILTER (too_long AND NOT desync) AS too_long FROM e GROUP BY conv")
def q1_skipped_exchanges(spark, sf):
    return Q.skipped_exchanges(talks(spark, sf), "conv", "date", "ord", "own", "text", 16, 250)


N_WORDS = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))"


@query(f"""WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WHERE coalesce(text, '') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM f),
m AS (SELECT conv_id, block, role, string_agg(text, ' ' ORDER BY turn) AS text FROM b GROUP BY 1, 2, 3), a AS (SELECT * FROM m UNION ALL SELECT conv_id, 0, 'system', 'Answer briefly.' FROM m GROUP BY conv_id HAVING arg_min(role, block) <> 'system'),
l AS (SELECT conv_id, block, role, '<|' || role || '|> ' || text AS line FROM a), x AS (SELECT conv_id, count(*) AS messages, string_agg(line, chr(10) ORDER BY block) AS t FROM l GROUP BY 1),
n AS (SELECT conv_id, role, lead(role) OVER w AS r2, line || chr(10) || lead(line) OVER w AS t FROM l WHERE conv_id IN (SELECT conv_id FROM x WHERE {N_WORDS} > 300) WINDOW w AS (PARTITION BY conv_id ORDER BY block))
SELECT conv_id, messages, CAST({N_WORDS} AS BIGINT) AS words, md5(t) AS text FROM x WHERE {N_WORDS} <= 300 UNION ALL SELECT conv_id, 2, CAST({N_WORDS} AS BIGINT), md5(t) FROM n WHERE role = 'user' AND r2 = 'assistant' AND {N_WORDS} <= 300""")
def q2_prepare(spark, sf):
    x = Q.prepare(Q.examples(table(spark, sf, "conversations")), 300, "Answer briefly.")
    return x.select("conv_id", F.size("messages").cast("long").alias("messages"), F.col("length").cast("long").alias("words"), F.md5("text").alias("text"))


# --- clusters


@query()
def m1_kmeans(spark, sf):
    x, _ = C.kmeans(table(spark, sf, "embeddings"), "embedding")
    return C.cluster_stats(x, "cluster", 7)


@query("SELECT CAST(i AS INT) AS label, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / (SELECT count(*) FROM embeddings) * 100, 1) AS pct FROM range(10) AS r(i) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) ON label = i")
def a18_cluster_stats(spark, sf):
    x = table(spark, sf, "embeddings")
    return C.cluster_stats(x.filter("label between 0 and 9"), "label", 10)


@query()
def m3_sub_clusters(spark, sf):
    x = C.sub_clusters(table(spark, sf, "embeddings"), "embedding", "label", 1, 3)
    return x.groupBy("label", "sub_cluster").agg(F.count("*").alias("n"))


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) <= 5")
def t11_cluster_sample(spark, sf):
    return C.sample_per(table(spark, sf, "embeddings"), "label", "vec_id", 5).select("label", "vec_id")


# --- message tables, filters, names

CHAT = f"SELECT event_id AS ord, 'u' || (user_id % 7) AS conversation, ts AS date, 'u' || (event_id % 3) AS sender_name, {SAID} AS text, CASE event_id % 5 WHEN 0 THEN 'reaction' WHEN 1 THEN 'system' ELSE 'text' END AS type, CASE event_id % 4 WHEN 0 THEN 'fr' ELSE 'en' END AS language FROM events"


def chat_table(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("conversation"), F.col("ts").alias("date"), F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("sender_name"), F.expr(SAID).alias("text"),
                    F.expr("CASE event_id % 5 WHEN 0 THEN 'reaction' WHEN 1 THEN 'system' ELSE 'text' END").alias("type"), F.expr("CASE event_id % 4 WHEN 0 THEN 'fr' ELSE 'en' END").alias("language"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01' AND o_custkey >= 5")
def f1_where(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("message_count"))
    from datetime import datetime

    return x.filter(S.where(source="1-URGENT", date_from=datetime(1996, 1, 1), date_to=datetime(1997, 1, 1), min_messages=5)).select("o_orderkey", "o_custkey")


@query(f"WITH c AS ({CHAT}) SELECT type, count(*) AS n FROM c WHERE type <> 'reaction' GROUP BY type")
def f9_without_reactions(spark, sf):
    return P.counts_by(P.without_reactions(chat_table(spark, sf)), "type")


@query(f"WITH c AS ({CHAT}), k AS (SELECT * FROM c WHERE conversation <> 'u1') SELECT conversation, count(*) AS n FROM k WHERE conversation IN (SELECT conversation FROM k WHERE sender_name = 'u1') GROUP BY 1")
def f10_spoken(spark, sf):
    return P.counts_by(P.spoken(chat_table(spark, sf), "u1"), "conversation")


OWNS = f"WITH c AS ({CHAT}), o AS (SELECT * FROM c WHERE sender_name = 'u2' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 3 AND NOT regexp_matches(text, {s('(?i)(?:' + ')|(?:'.join(V.NOISE) + ')')}))"


@query(f"{OWNS} SELECT conversation, count(*) AS n FROM o WHERE language NOT IN ('fr') GROUP BY 1 HAVING count(*) >= 1")
def f7_f16_own_messages(spark, sf):
    return P.counts_by(P.own_messages(chat_table(spark, sf), "u2", languages_out=["fr"]), "conversation")


@query(f"{OWNS} SELECT conversation, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 2")
def f17_conversations(spark, sf):
    return P.with_own_messages(chat_table(spark, sf), "u2")


GOOD = f"NOT (regexp_matches(trim(text), {s(LOWQ)}) OR regexp_matches(text, {s('(?i)(?:' + ')|(?:'.join(V.ARTEFACTS) + ')')}) OR len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '(?i)\\s*\\(edited\\)\\s*$', '')), '\\s+'), lambda x: x <> '')) < 2)"


@query(f"WITH c AS ({CHAT}) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN date < TIMESTAMP '2024-06-01' - INTERVAL 365 DAY THEN 'old' WHEN language <> 'en' THEN 'language' WHEN type <> 'text' THEN 'type' WHEN NOT ({GOOD}) THEN 'quality' ELSE 'kept' END AS reason FROM c) GROUP BY reason")
def f8_a25_export_reasons(spark, sf):
    return Q.export_stats(chat_table(spark, sf), P.export_reason("2024-06-01", years=1))


REASON = f"CASE WHEN date < TIMESTAMP '2024-06-01' - INTERVAL 365 DAY THEN 'old' WHEN language <> 'en' THEN 'language' WHEN type <> 'text' THEN 'type' WHEN NOT ({GOOD}) THEN 'quality' ELSE 'kept' END"


@query(f"WITH c AS ({CHAT}), r AS (SELECT *, {REASON} AS reason FROM c), k AS (SELECT DISTINCT conversation, text FROM r WHERE reason = 'kept') SELECT (SELECT count(*) FROM r) AS total_messages, (SELECT count(*) FROM r WHERE reason <> 'kept') AS filtered_messages, (SELECT count(*) FROM k) AS pairs_exported, (SELECT count(DISTINCT conversation) FROM k) AS conversations_used")
def a25_export_summary(spark, sf):
    c, reason = chat_table(spark, sf), P.export_reason("2024-06-01", years=1)
    return Q.export_summary(c, c.filter(reason == "kept").select("conversation", "text").distinct(), reason)


SHOWN = "CASE WHEN conv_id % 3 = 0 THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' ELSE text END"


@query(f"WITH t AS (SELECT conv_id * 1000 + turn AS o, {SHOWN} AS t FROM conversations), h AS (SELECT * FROM t ORDER BY o LIMIT 10) SELECT (SELECT bool_or(contains(t, '<|im_start|>')) FROM h) AS roles_shown, (SELECT bool_or(contains(t, '<|im_end|>')) FROM h) AS ends_shown, count(*) AS examples, count(*) FILTER (NOT contains(t, '<|im_start|>')) AS without_special, count(*) FILTER (NOT contains(t, '<|im_start|>')) > 0.5 * count(*) AS mostly_bare FROM t")
def a28_text_diagnostics(spark, sf):
    x = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), F.expr(SHOWN.replace("chr(10)", "char(10)")).alias("t"))
    return Q.text_diagnostics(x, "t", "o", ["<|im_start|>"])


@query(f"WITH c AS ({CHAT}) SELECT ord, conversation FROM c WHERE conversation = 'u3' ORDER BY date DESC, ord DESC LIMIT 100")
def t10_newest(spark, sf):
    return P.newest(chat_table(spark, sf), 100, F.col("conversation") == "u3").select("ord", "conversation")


@query(f"WITH c AS ({CHAT}) SELECT sender_name, count(*) AS n, round(avg(ord % 3 - 1), 6) AS polarity FROM c WHERE contains(sender_name, 'u') GROUP BY 1 ORDER BY 1 LIMIT 1")
def a29_person_stats(spark, sf):
    return P.person_stats(chat_table(spark, sf), "U", F.col("ord") % 3 - 1).withColumn("polarity", F.round("polarity", 6))


@query(f"WITH c AS ({CHAT}) SELECT conversation, language, count(*) AS n FROM c GROUP BY 1, 2")
def a11_a30_counts(spark, sf):
    return P.counts_by(chat_table(spark, sf), "conversation", "language")


@query("SELECT o_orderkey, 'visit_' || strftime(o_orderdate, '%Y-%m-%d_%H:%M:%S') || '_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') || '_' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority) - 1)::VARCHAR, 3, '0') AS id FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate, o_orderpriority) = 1")
def p18_visit_ids(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("start_time"), F.col("o_orderpriority").alias("name"))
    x = P.visit_ids(x, "o_custkey").withColumn("c", F.count("*").over(Window.partitionBy("o_custkey", "start_time", "name")))
    return x.filter("c = 1").select("o_orderkey", "id")


@query("SELECT o_orderkey, 'visit_' || strftime(o_orderdate, '%Y-%m-%d_%H:%M:%S') || '_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') || '_' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority, o_orderkey) - 1)::VARCHAR, 3, '0') AS id FROM orders")
def p18_all_visit_ids(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("start_time"), F.col("o_orderpriority").alias("name"))
    return P.visit_ids(x, "o_custkey", "o_orderkey").select("o_orderkey", "id")


@query("SELECT lower(c_name) || '_' || c_custkey AS conversation, c_name AS name FROM customer")
def p24_display_names(spark, sf):
    c = table(spark, sf, "customer").select("c_name", "c_custkey")
    letters = F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")
    ids = c.select(F.concat(F.lower("c_name"), F.lit("_"), F.col("c_custkey").cast("string")).alias("conversation"), F.concat(F.lit("friend"), letters).alias("bare"), "c_name")
    friends = ids.select(F.col("bare").alias("name"), F.lit(0).alias("pos"))
    found = P.display_names(ids.select(F.concat("bare", F.lit("_12")).alias("conversation")), friends).select(F.col("name").alias("bare")).distinct()
    return ids.join(found, "bare").select("conversation", F.col("c_name").alias("name"))


@query(f"WITH {BOTH} SELECT from_label, to_label, count(*) AS n FROM b GROUP BY 1, 2")
def j8_both_ways(spark, sf):
    return G.both_ways(edges(spark, sf)).groupBy("from_label", "to_label").agg(F.count("*").alias("n"))


@query(f"WITH {BOTH}, n AS (SELECT c_custkey::VARCHAR AS name FROM customer), d AS (SELECT from_name, count(*) AS c FROM b WHERE from_label = 'Person' AND rel_type = 'PLACED' GROUP BY 1) SELECT name, coalesce(c, 0) AS degree FROM n LEFT JOIN d ON name = from_name WHERE upper(name) NOT IN ('1', '2')")
def j10_f19_optional(spark, sf):
    n = table(spark, sf, "customer").select(F.lit("Person").alias("label"), F.col("c_custkey").cast("string").alias("name"))
    return G.degree(n, edges(spark, sf).filter("rel_type = 'PLACED'"), exclude=["1", "2"]).select("name", "degree")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days FROM events GROUP BY 1")
def u4_distinct_parts(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.size(F.array_distinct(F.collect_list("event_type"))).cast("long").alias("kinds"), F.countDistinct(F.date_format("ts", "yyyy-MM-dd")).alias("days"))
    return g


@query("SELECT label, count(*) AS n, round_even(count(*) / sum(count(*)) OVER () * 100, 1) AS pct, round(avg(embedding[1]), 4) AS x, round(avg(embedding[2]), 4) AS y FROM embeddings WHERE label >= 0 GROUP BY label")
def a19_a20_sub_cluster_stats(spark, sf):
    x = table(spark, sf, "embeddings").filter("label >= 0").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    exact = x.groupBy("label").agg(F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))
    return C.sub_cluster_stats(x, "label", []).join(exact, "label")


@query("WITH n AS (SELECT n_nationkey AS pos, lower(n_name) AS name, regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g') AS plain FROM nation), q AS (SELECT c_custkey AS q, 'a letter to ' || plain || ' today' AS t FROM customer JOIN n ON c_nationkey = pos) SELECT q, arg_min(name, pos) AS name FROM q JOIN n ON contains(t, plain) GROUP BY q")
def j7_name_mention(spark, sf):
    n = table(spark, sf, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    plain = n.withColumn("name", F.regexp_replace("name", "[^a-z0-9]+", " "))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = c.select(F.col("c_custkey").alias("q"), F.concat(F.lit("a letter to "), F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", " "), F.lit(" today")).alias("text"))
    names = plain.select("name", "pos")
    return J.name_mention(q, names).join(n.withColumn("name2", F.regexp_replace("name", "[^a-z0-9]+", " ")).select("name2", F.col("name").alias("full")), F.col("name") == F.col("name2")).select("q", F.col("full").alias("name"))


@query("SELECT mktsegment, n, round(w, 6) AS w, abs(sum(w) OVER () - 1) <= 0.01 AS valid, round_even(w / sum(w) OVER (), 3) AS normalised FROM (SELECT c_mktsegment AS mktsegment, count(*) AS n, count(*) / 1000 AS w FROM customer GROUP BY 1)")
def f20_weights(spark, sf):
    x = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.count("*").alias("n")).withColumn("w", F.col("n") / 1000)
    return C.weights_valid(x, "w").withColumn("w", F.round("w", 6))


@query("SELECT vec_id FROM embeddings ORDER BY md5(vec_id || ':42'), vec_id LIMIT 50")
def t12_sample(spark, sf):
    return C.sample_rows(table(spark, sf, "embeddings"), "vec_id", 50).select("vec_id")


@query(f"SELECT doc_id AS id, round({DIST}, 5) AS distance FROM documents JOIN embeddings ON doc_id = vec_id WHERE contains(lower(text), 'theat') ORDER BY {DIST}, doc_id LIMIT 50")
def v7_history(spark, sf):
    d = corpus(spark, sf).withColumns({"date": F.lit(0), "ord": F.col("id"), "conversation": F.col("source")})
    return P.history_answer(d, ASK, ASKED, about="theat").select("id", F.round("distance", 5).alias("distance"))


@query()
def m2_choose_k(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return C.choose_k(x, "v")


ASK7 = f"{ASK} 7"
WORDS7 = ", ".join(map(s, sorted(set(ASK7.split()))))
HELD7 = HELD.replace(f"term IN ({', '.join(map(s, ASK.split()))})", f"term IN ({WORDS7})")
OV7 = f"len(list_intersect(regexp_split_to_array(lower(content), '\\s+'), [{WORDS7}])) / 5"
FACTS7 = """ed AS (SELECT 'Person' AS from_label, o_custkey::VARCHAR AS from_name, 'placed' AS rel, 'PLACED' AS rel_type, 'Order' AS to_label, o_orderkey::VARCHAR AS to_name, ' [since ' || strftime(o_orderdate, '%Y-%m-%d') || ']' AS more FROM orders UNION ALL SELECT 'Person', c_custkey::VARCHAR, 'lives in', 'LIVES_IN', 'Country', c_nationkey::VARCHAR, '' FROM customer UNION ALL SELECT 'Country', n_nationkey::VARCHAR, 'in region', 'IN_REGION', 'Region', n_regionkey::VARCHAR, '' FROM nation),
bo AS (SELECT * FROM ed UNION ALL SELECT to_label, to_name, rel, rel_type, from_label, from_name, more FROM ed), f15 AS (SELECT *, row_number() OVER (ORDER BY rel_type || '|' || to_label || '|' || to_name || '|' || from_name) AS r FROM bo WHERE from_name = '7' QUALIFY r <= 15),
fl AS (SELECT from_name || ' ' || rel || ' ' || to_name || ' (' || to_label || ')' || more AS fact, min(r) AS r FROM f15 GROUP BY 1), fa AS (SELECT '## Facts' || chr(10) || string_agg(fact, chr(10) ORDER BY r) AS t FROM fl)"""


@query(f"""WITH {HELD7}, best AS (SELECT * FROM fu ORDER BY rrf_score DESC, s_pos NULLS LAST, b_pos NULLS LAST LIMIT 20), five AS (SELECT content, {OV7} AS o, rrf_score FROM best ORDER BY o DESC, rrf_score DESC, s_pos NULLS LAST, b_pos NULLS LAST LIMIT 5),
me AS (SELECT '## Messages' || chr(10) || string_agg(content, chr(10) || '---' || chr(10) ORDER BY o DESC, rrf_score DESC, content) AS t FROM five), {FACTS7}
SELECT md5(fa.t || chr(10) || chr(10) || me.t) AS context, CAST(length(fa.t || chr(10) || chr(10) || me.t) AS INT) AS n_chars FROM fa, me""")
def v6_answer_context(spark, sf):
    from .plans.context import answer_context

    x = answer_context(corpus(spark, sf), edges(spark, sf).withColumn("seq", F.lit(0)), ASK7, ASKED, names=["7"], n=20, k=5)
    return x.select(F.md5("context").alias("context"), F.length("context").alias("n_chars"))


@query("SELECT e_type AS user, day AS start, n FROM (SELECT event_type AS e_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def s2_daily_counters(spark, sf):
    from .streaming.twins import counters

    return counters(table(spark, sf, "events"), "ts", "event_type").select(F.col("event_type").alias("user"), F.col("start"), "n")


@query(f"WITH {SES} SELECT conversation, min(date) AS start, count(*) AS n FROM z GROUP BY conversation, session")
def s1_session_windows(spark, sf):
    from .streaming.twins import sessions

    return sessions(messages(spark, sf), "conversation", "date", "8 hours").select("conversation", "start", "n")


# --- readers, over files that Spark writes from the tables


def chat_pages(spark, sf) -> str:
    """The conversations as chat pages, in folders of many conversations."""
    c = table(spark, sf, "conversations")
    safe = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    date = F.timestamp_seconds(F.unix_seconds(F.lit("2015-06-18 21:00:00").cast("timestamp")) + F.col("conv_id") * 600 + F.col("turn"))
    html = F.concat(F.lit('<section class="_a6-g"><h2>'), "role", F.lit('</h2><div class="_a6-p"><div>'), safe, F.lit('</div></div><div class="_a72d">'), F.date_format(date, "MMM d, yyyy h:mm:ss a"), F.lit("</div></section>"))
    folder = shared_folder(spark, "pages")
    c.select(html.alias("value"), F.concat(F.lit("inbox_"), F.pmod("conv_id", F.lit(8)).cast("string")).alias("inbox")).write.partitionBy("inbox").text(folder)
    return folder


PAGE_ROWS = r"SELECT 'inbox=inbox_' || (conv_id % 8) AS folder, role AS sender_name, TIMESTAMP '2015-06-18 21:00:00' + to_seconds(CAST(conv_id * 600 + turn AS BIGINT)) AS date, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''"


@query(PAGE_ROWS)
def s1_chat_pages(spark, sf):
    x = export_files(spark, chat_pages(spark, sf), "chat", pattern="*.txt")
    return x.select("folder", "sender_name", F.col("date").cast("timestamp").alias("date"), F.md5("text").alias("text"))


@query(f"SELECT * FROM ({PAGE_ROWS}) WHERE date >= TIMESTAMP '2015-06-19 00:00:00' AND folder IN ('inbox=inbox_1', 'inbox=inbox_6')")
def s1_chat_pages_filtered(spark, sf):
    x = export_files(spark, chat_pages(spark, sf), "chat", pattern="*.txt")
    x = x.filter("folder in ('inbox=inbox_1', 'inbox=inbox_6') and date >= timestamp_ntz'2015-06-19 00:00:00'")
    return x.select("folder", "sender_name", F.col("date").cast("timestamp").alias("date"), F.md5("text").alias("text"))


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM documents")
def s4_large_json(spark, sf):
    folder = shared_folder(spark, "arrays")
    write_arrays(table(spark, sf, "documents"), folder)
    x = rows_of(spark, folder, "doc_id long, text string, lang string, source string, n_chars long", 1 << 18, pattern="*.txt")
    return x.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"))


NAMED = r"""n AS (SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark)),
t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)"""


def benchmark_words(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name")).distinct()


@query(f"WITH {NAMED} SELECT id, CASE WHEN name = lower(name) THEN 'word' ELSE 'name' END AS label, name, count(*) AS n FROM t JOIN n ON w = lower(name) GROUP BY ALL")
def m7_entities(spark, sf):
    names = benchmark_words(spark, sf).withColumn("label", F.when(F.col("name") == F.lower("name"), "word").otherwise("name"))
    return entities(table(spark, sf, "documents"), names, "doc_id").select("id", "label", "name", "n")


@query(f"WITH {NAMED}, p AS (SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS pos FROM n) SELECT id AS q, arg_min(name, pos) AS name FROM t JOIN p ON w = lower(name) GROUP BY id")
def j7_many_names(spark, sf):
    names = benchmark_words(spark, sf).withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.length("name")), "name")))
    return first_mention(table(spark, sf, "documents").withColumnRenamed("doc_id", "q"), names)


SHARE = {e: "(" + " + ".join(f"contains(lower(text), {s(k)})::INT" for k in V.EMOTION_WORDS.get(e, [])) + ")" if V.EMOTION_WORDS.get(e) else "0" for e in V.EMOTIONS}
ALL_SHARES = " + ".join(SHARE.values())


@query(f"SELECT doc_id, {', '.join(f'round(CASE WHEN {ALL_SHARES} = 0 THEN 0.2 ELSE {n} / ({ALL_SHARES}) END, 6) AS {e}' for e, n in SHARE.items())} FROM documents")
def m4_emotion_model(spark, sf):
    from .plans.seams import emotion_model, word_shares

    x = table(spark, sf, "documents").select("doc_id", emotion_model(word_shares)(F.col("text")).alias("e"))
    return x.select("doc_id", *[F.round(F.col(f"e.{e}"), 6).alias(e) for e in V.EMOTIONS])


# --- rules and readers on whole tables


COUNTED = "c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT 'Person' AS from_label, user_id::VARCHAR AS from_name, 'PLAYED' AS rel_type, 'Game' AS to_label, event_type AS to_name, n FROM c UNION ALL SELECT 'Person', user_id::VARCHAR, 'WAS_FAN_OF', 'Activity', 'the ' || event_type, n FROM c)"
TERMS = ["click", "VIEW", "1", "purchase", "nobody"]


@query(f"""WITH {COUNTED}, b AS (SELECT * FROM e UNION ALL SELECT to_label, to_name, rel_type, from_label, from_name, n FROM e), t AS (SELECT * FROM (VALUES {', '.join(f"({i}, {s(x.lower())})" for i, x in enumerate(TERMS))}) AS t(pos, term)),
j AS (SELECT *, CASE WHEN lower(from_name) = term THEN 1 ELSE 2 END AS score FROM b JOIN t ON lower(from_name) = term OR (from_label IN ('Game', 'Activity') AND contains(lower(from_name), term))),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score, n DESC, rel_type || '|' || to_label || '|' || to_name || '|' || from_name) AS r FROM j QUALIFY r <= 15)
SELECT from_name || CASE rel_type WHEN 'PLAYED' THEN ' played ' ELSE ' was fan of (PAST) ' END || to_name || ' (' || to_label || ') [count: ' || n || ']' AS fact, CAST(min(pos * 1000 + r) AS INT) AS pos FROM r GROUP BY 1""")
def g1_top_facts(spark, sf):
    """Five terms over all edges: exact names first, then games and activities that contain the term, fifteen of each."""
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("fan", F.concat(F.lit("the "), "event_type"))
    e = G.triples(c, [("Person", "user_id", "PLAYED", "Game", "event_type", {"count": "n"}), ("Person", "user_id", "WAS_FAN_OF", "Activity", "fan", {"count": "n"})])
    return G.facts(e, TERMS)


@query(f"WITH {HELD}, best AS (SELECT * FROM fu ORDER BY rrf_score DESC, s_pos NULLS LAST, b_pos NULLS LAST LIMIT 20) SELECT md5(content) AS content, CAST({OV} AS DOUBLE) AS rerank_score FROM best WHERE {OV} >= 0.25 ORDER BY {OV} DESC, rrf_score DESC, s_pos NULLS LAST, b_pos NULLS LAST LIMIT 15")
def f3_threshold(spark, sf):
    x = S.hybrid(corpus(spark, sf), ASK, ASKED, 20, 15, threshold=0.25)
    return x.select(F.md5("content").alias("content"), F.col("rerank_score").cast("double").alias("rerank_score"))


@query(f"WITH {M} SELECT conversation, ord FROM m WHERE sender_name = 'click' AND date >= TIMESTAMP '2024-01-10 00:00:00'")
def f2_keyword_filter(spark, sf):
    x = messages(spark, sf).withColumnRenamed("sender_name", "source")
    return x.filter(S.keyword_where("click", "2024-01-10 00:00:00")).select("conversation", "ord")


@query("SELECT event_id, lat, lng FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / 1000 END AS lat, value / 500 - 0.05 AS lng, CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS ts, CASE WHEN event_type = 'click' THEN 'lat 1' ELSE event_type END AS address FROM events) WHERE lat <> 0 AND lng <> 0 AND ts IS NOT NULL AND abs(lat) > 0.1 AND abs(lng) > 0.1 AND address NOT LIKE 'lat%'")
def f12_f14_fixes(spark, sf):
    e = table(spark, sf, "events")
    x = e.select("event_id", F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value") / 1000).alias("lat"), (F.col("value") / 500 - 0.05).alias("lng"), F.when(F.col("event_type") != "view", F.col("ts")).alias("ts"), F.when(F.col("event_type") == "click", "lat 1").otherwise(F.col("event_type")).alias("address"))
    return x.filter(A.valid_fix() & A.sane_gps()).select("event_id", "lat", "lng")


@query("SELECT n_nationkey, '❤ ' || n_name AS said FROM nation")
def f5_emoji_reactions(spark, sf):
    n = table(spark, sf, "nation").withColumn("mark", F.explode(F.array(*map(F.lit, ("❤ ", "so ", "!!!! "))))).withColumn("said", F.concat("mark", "n_name"))
    return n.filter(T.is_emoji_reaction("said")).select("n_nationkey", "said")


@query("SELECT event_id FROM events WHERE event_type <> 'click' OR coalesce(value > 20, true)")
def f18_relevant(spark, sf):
    x = table(spark, sf, "events")
    return P.keep_relevant(x, F.when(F.col("event_type") == "click", F.col("value") > 20)).select("event_id")


@query("SELECT doc_id, trim(text, ' ') AS text FROM documents")
def p9_without_emoji(spark, sf):
    x = table(spark, sf, "documents").withColumn("said", F.replace("text", F.lit(" "), F.lit("😂 ♥🚀")))
    return x.select("doc_id", T.without_emoji("said").alias("text"))


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS at, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) END AS read FROM orders")
def p2_activity_dates(spark, sf):
    x = table(spark, sf, "orders").withColumn("at", F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400))
    said = F.when(F.col("o_orderkey") % 4 == 0, "some day").when(F.col("o_orderkey") % 4 == 1, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("at", "MMM d, yyyy, h:mm:ss a"))
    return x.withColumn("said", said).select("o_orderkey", "at", T.activity_timestamp("said").alias("read"))


@query("SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text, chr(10) ORDER BY turn) AS told FROM (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS text FROM conversations) WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id")
def p39_history(spark, sf):
    x = Q.examples(table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text"))))
    told = F.array_join(F.transform("h", lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n")
    return x.select("conv_id", Q.history("messages").alias("h")).filter(F.size("h") > 0).select("conv_id", F.size("h").cast("long").alias("n"), told.alias("told"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def p30_content_blocks(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    blocks = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda b: F.struct(b["role"].alias("type"), b["text"].alias("text"))).alias("blocks"))
    return blocks.select("conv_id", Q.flatten_content("blocks").alias("content")).filter("content <> ''")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'neutral' ELSE event_type END AS emotion, round_even((p + 1) / 2, 2) AS emotional_valence, round_even(CASE WHEN event_type <> 'view' AND q < 0.5 THEN 0.5 + 0.5 * q ELSE q END, 2) AS emotion_arousal, CASE WHEN p > 0.3 THEN 'Very Positive' WHEN p > 0.1 THEN 'Positive' WHEN p < -0.3 THEN 'Very Negative' WHEN p < -0.1 THEN 'Negative' ELSE 'Neutral' END AS label FROM (SELECT *, (event_id % 17 - 8) / 8 AS p, (event_id % 9) / 8 AS q FROM events)")
def p37_p38_feelings(spark, sf):
    x = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "neutral").otherwise(F.col("event_type")).alias("e"), ((F.col("event_id") % 17 - 8) / 8).alias("p"), ((F.col("event_id") % 9) / 8).alias("q"))
    return x.select("event_id", E.keyword_record(F.col("e"), F.col("p"), F.col("q")).alias("k"), E.sentiment_label(F.col("p")).alias("label")).select("event_id", "k.*", "label")


@query("SELECT l_orderkey, l_linenumber, coalesce(try_cast(said AS DOUBLE), 0) AS x, coalesce(CAST(trunc(try_cast(said AS DOUBLE)) AS INT), 0) AS i FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN l_returnflag WHEN 1 THEN l_extendedprice::VARCHAR ELSE '-' || l_quantity END AS said FROM lineitem)")
def p40_safe_numbers(spark, sf):
    said = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).when(F.col("l_linenumber") % 3 == 1, F.col("l_extendedprice").cast("string")).otherwise(F.concat(F.lit("-"), F.col("l_quantity").cast("string")))
    return table(spark, sf, "lineitem").withColumn("said", said).select("l_orderkey", "l_linenumber", T.safe_double("said").alias("x"), T.safe_int("said").alias("i"))


@query(f"WITH {M} SELECT conversation, ord, date FROM m ORDER BY date DESC, ord DESC LIMIT 100")
def t15_newest(spark, sf):
    return P.newest(messages(spark, sf), 100).select("conversation", "ord", "date")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS place FROM documents")
def t14_shuffled(spark, sf):
    drawn = table(spark, sf, "documents").select("doc_id", C.draw("doc_id").alias("drawn"))
    return W.with_ordinal_id(drawn, ["drawn", "doc_id"], "").select("doc_id", (F.col("id").cast("long") + 1).alias("place"))


@query("SELECT count(*) FILTER (docs > 0 OR pages > 0) AS active FROM (SELECT lang, count(*) FILTER (n_chars > 100) AS docs, 0 AS pages FROM documents GROUP BY lang UNION ALL SELECT source, 0, count(*) FILTER (n_chars > 10000000) FROM documents GROUP BY source)")
def a5_active_sources(spark, sf):
    d = table(spark, sf, "documents")
    by = lambda c, docs, nodes: d.groupBy(c).agg(docs.alias("documents"), nodes.alias("nodes")).drop(c)
    none = F.lit(0).cast("long")
    return A.active(by("lang", F.count_if(F.col("n_chars") > 100), none).unionByName(by("source", F.max(none), F.count_if(F.col("n_chars") > 10_000_000))))


@query("SELECT CAST(greatest(1, n // 32 * 3) AS BIGINT) AS steps, CAST(greatest(1, floor(greatest(1, n // 32 * 3) * 0.05)) AS BIGINT) AS warmup FROM (SELECT count(DISTINCT conv_id) AS n FROM conversations)")
def a33_training_steps(spark, sf):
    n = table(spark, sf, "conversations").select("conv_id").distinct().count()
    return spark.createDataFrame([A.training_steps(n, 8, 4, 3, 0.05)], "steps long, warmup long")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS sender_name, 'text' AS type, coalesce(lang, 'en') AS language, md5(text) AS text FROM documents")
def s3_message_arrays(spark, sf):
    folder = shared_folder(spark, "messages")
    d = table(spark, sf, "documents")
    write_arrays(d.select(F.col("doc_id").cast("string").alias("conversation"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("sender_name"), F.col("lang").alias("language"), "text"), folder)
    return X.messages_json(spark, folder).select(F.col("conversation").cast("long").alias("id"), "sender_name", "type", "language", F.md5("text").alias("text"))


@query("SELECT o_custkey::VARCHAR AS appid, CAST(o_orderdate AS TIMESTAMP) AS start_at, CAST(greatest(0, (o_orderkey % 500 - 20) * 60) AS BIGINT) AS duration_s FROM orders WHERE o_orderkey % 7 <> 0")
def s6_game_sessions(spark, sf):
    folder = shared_folder(spark, "games")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    shown = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd HH:mm:ss")
    x = table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("appid"), shown(start).alias("start_at"), F.when(F.col("o_orderkey") % 7 == 0, "never").otherwise(shown(start + (F.col("o_orderkey") % 500 - 20) * 60)).alias("end_at"))
    x.write.option("header", True).csv(folder)
    return X.game_sessions(spark, folder).select("appid", "start_at", F.col("duration_s").cast("long").alias("duration_s"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || text, chr(10) ORDER BY turn)) AS told FROM conversations GROUP BY conv_id")
def s12_example_lines(spark, sf):
    folder = shared_folder(spark, "examples")
    X.write_json(Q.examples(table(spark, sf, "conversations")).withColumn("conversation", F.col("conv_id").cast("string")), folder)
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "\n")
    return X.examples_jsonl(spark, folder).select(F.col("conversation").cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n"), F.md5(told).alias("told"))


@query("SELECT c_nationkey AS nation, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def k4_appended(spark, sf):
    folder = shared_folder(spark, "people")
    for t, a in (("customer", "c"), ("supplier", "s")):
        X.append_parquet(table(spark, sf, t).select(F.col(f"{a}_nationkey").alias("nation"), F.col(f"{a}_name").alias("name")), folder)
    return spark.read.parquet(folder)


@query("SELECT p_partkey::VARCHAR AS key, p_name AS value FROM part")
def s15_lookup(spark, sf):
    folder = shared_folder(spark, "lookup")
    table(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(4)).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), "p_name")))).alias("value")).repartition(4, "g").select("value", "g").write.partitionBy("g").text(folder)
    return X.lookup_json(spark, folder).select("key", "value")
