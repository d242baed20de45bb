"""Training pairs against a plain walk, silhouettes and clusters against plain loops, names against a search of each."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlog.operators import cluster, entities, training

# --- training pairs


def walk(rows, max_turns, reply_min, most):
    """(conversation, first block, contents) by going from message to message; and counts of what is skipped."""
    out, skipped = [], {}
    for conv in {r[0] for r in rows}:
        blocks = []
        for _, date, _, own, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2])):
            if blocks and blocks[-1][0] == own:
                blocks[-1][1].append(text)
                blocks[-1][3] = date
            else:
                blocks.append([own, [text], date, date])
        late = long = 0
        now, at, hard = [], None, max(3 * max_turns, 10)
        for k in range(len(blocks) - 1):
            (o, said, _, end), (p, reply, begin, _) = blocks[k], blocks[k + 1]
            if o or not p:
                continue
            said, reply = "\n".join(said), "\n".join(reply)
            is_late, is_long = (begin - end).total_seconds() > 60 * reply_min, len(said.split()) > most or len(reply.split()) > most
            late, long = late + is_late, long + (is_long and not is_late)
            if is_late or is_long:
                if now:
                    out.append((conv, at, now))
                now = []
                continue
            if now and (len(now) // 2 >= hard or (len(now) // 2 >= max_turns and not now[-1].endswith("?"))):
                out.append((conv, at, now))
                now = []
            if not now:
                at = k + 1
            now = [*now, said, reply]
        if now:
            out.append((conv, at, now))
        skipped[conv] = (late, long)
    return sorted(out), skipped


def talk(seed, n, convs=3, ask=0.5):
    r = random.Random(seed)
    t, rows = datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(minutes=r.choice([1, 1, 2, 3, 40]))
        rows.append((f"c{r.randint(1, convs)}", t, i, r.random() < 0.5, " ".join(["w"] * r.choice([1, 2, 3, 9])) + ("?" if r.random() < ask else "")))
    return rows


SCHEMA = "conv string, date timestamp, ord long, own boolean, text string"
COLUMNS = ("conv", "date", "ord", "own", "text")


@pytest.mark.parametrize("max_turns,ask", [(1, 0.5), (2, 0.6), (4, 0.95)])
def test_training_pairs(spark, max_turns, ask):
    rows = talk(max_turns, 900, ask=ask)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, skipped = walk(rows, max_turns, 39, 12)
    got = training.training_pairs(df, *COLUMNS, max_turns, 39, 12).collect()
    assert sorted((r["conv"], r["start"], [m["content"] for m in r["messages"]]) for r in got) == want and len({len(w[2]) for w in want}) > 2
    assert {m["role"] for r in got for m in r["messages"][::2]} == {"user"}
    found = training.skipped_exchanges(df, *COLUMNS, 39, 12).collect()
    assert {r["conv"]: (r["desync"], r["too_long"]) for r in found} == skipped and min(map(min, skipped.values())) > 0
    (first,) = training.training_pairs(df.filter("ord < 0 or conv = 'c1'"), *COLUMNS, max_turns, 39, 12, system="be kind").orderBy("start").limit(1).collect()
    assert tuple(first["messages"][0]) == ("system", "be kind")
    assert training.training_pairs(df.filter("false"), *COLUMNS).collect() == []


def test_one_long_conversation(spark):
    t0 = datetime(2024, 1, 1)
    n = 100_000
    df = spark.range(n).select(F.lit("c").alias("conv"), F.timestamp_seconds(F.lit(int(t0.timestamp())) + F.col("id")).alias("date"), F.col("id").alias("ord"), (F.col("id") % 2 == 1).alias("own"), F.concat(F.lit("m"), "id", F.when(F.col("id") % 6 == 1, "?").otherwise("")).alias("text"))
    got = training.training_pairs(df, *COLUMNS, 1).agg(F.count("*").alias("n"), F.sum(F.size("messages")).alias("m"), F.max(F.size("messages")).alias("most")).first()
    # replies 1, 7, 13 ask: that exchange and the next are one example, the third is one of its own
    assert (got["m"], got["most"]) == (n, 4) and got["n"] == sum(1 for k in range(n // 2) if k % 3 != 1)


# --- clusters


def silhouette(v, lab):
    total = 0.0
    for i in range(len(v)):
        d = [float(np.sqrt(((v[i] - w) ** 2).sum())) for w in v]
        own = [d[j] for j in range(len(v)) if lab[j] == lab[i] and j != i]
        if own:
            a, b = np.mean(own), min(np.mean([d[j] for j in range(len(v)) if lab[j] == m]) for m in set(lab) if m != lab[i])
            total += (b - a) / max(a, b)
    return total / len(v)


def test_silhouettes(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(m, 0.7, size=(30, 3)) for m in (0, 3, 6)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    centres = {1: [[0.0] * 3], 2: [[0.0] * 3, [6.0] * 3], 4: [[0.0] * 3, [3.0] * 3, [6.0] * 3, [99.0] * 3], 5: [v[7].tolist(), [1.0] * 3, [2.0, 3, 4], [5.0] * 3, [6.0] * 3]}
    got = {x["k"]: x["silhouette"] for x in cluster.silhouettes(df, "v", centres, "id", block=16).collect()}
    assert got.pop(1) is None
    for k, s in got.items():
        lab = [int(np.argmin([((x - np.array(c)) ** 2).sum() for c in centres[k]])) for x in v]
        assert abs(s - silhouette(v, lab)) < 1e-9
    rows = cluster.choose_k(df, "v", range(2, 6)).orderBy("k").collect()
    assert [x["k"] for x in rows] == [2, 3, 4, 5] and max(rows, key=lambda x: x["silhouette"])["k"] == 3
    assert all(a["inertia"] > b["inertia"] for a, b in zip(rows, rows[1:]))


def test_clusters_are_a_fixed_point(spark):
    """Labels are those of the nearest centre, centres the means of their members, and sub-clusters stay inside."""
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(m, 0.4, size=(40, 2)) for m in (0, 5, 10, 15)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    x, centres = cluster.kmeans(df, "v", 4, n_init=4)
    lab = np.array([y["cluster"] for y in x.orderBy("id").collect()])
    near = ((v[:, None] - np.array(centres)[None]) ** 2).sum(2)
    assert (near.argmin(1) == lab).all() and sorted(np.bincount(lab)) == [40] * 4
    assert np.allclose([v[lab == k].mean(0) for k in range(4)], centres)
    inner = cluster.sub_clusters(x, "v", "cluster", int(lab[0]), 2).orderBy("id").collect()
    part = np.array([y["sub_cluster"] for y in inner])
    assert set(part[lab == lab[0]]) == {0, 1} and set(part[lab != lab[0]]) == {-1} and len(inner) == 160
    mean = [v[part == k].mean(0) for k in (0, 1)]
    inside = v[lab == lab[0]]
    assert (((inside[:, None] - np.array(mean)[None]) ** 2).sum(2).argmin(1) == part[lab == lab[0]]).all()


# --- names


def spans_of(text, names, borders):
    t, out = text.lower(), set()
    for n in names:
        if not n or not n.strip():
            continue
        k = t.find(n.lower())
        while k >= 0:
            e = k + len(n)
            if not borders or not ((k and re.match(r"\w", t[k - 1]) and re.match(r"\w", t[k])) or (e < len(t) and re.match(r"\w", t[e]) and re.match(r"\w", t[e - 1]))):
                out.add((n, k, e))
            k = t.find(n.lower(), k + 1)
    return out


@pytest.mark.parametrize("most", [500_000, 4])
def test_names(spark, monkeypatch, most):
    monkeypatch.setattr(entities, "NAMES", most)
    r = random.Random(9)
    names = ["Ann", "ann", "ann lee", "lee", "e", "(x)", "é a", "a.b", "lee ann lee", "  ", "", None, "long name of many words"]
    bits = ["Ann", "Lee", " ", " ", "é", "a", ".", "b", "(x)", "_", "e", "\n", "annex", "long name of many words"]
    texts = [(i, "".join(r.choices(bits, k=r.randint(0, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, "x" * 9000 + " Ann lee.")]
    df, nf = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for borders in (True, False):
        got = entities.mentions(df, nf, borders=borders).collect()
        assert sorted((x["id"], x["name"], x["start"], x["end"]) for x in got) == sorted((i, *s) for i, t in texts if t for s in spans_of(t, [n for n in names if n], borders))
    labelled = nf.withColumn("label", F.lit("P"))
    want: dict = {}
    for i, t in texts:
        reach = 0
        for k, minus in sorted({(s, -e) for _, s, e in spans_of(t or "", [n for n in names if n], True)}):
            if k >= reach:
                reach = -minus
                for n in names:
                    if n and n.lower() == t.lower()[k:reach]:
                        want.setdefault((i, n), []).append(k)
    got = entities.entities(df, labelled).collect()
    assert sorted((x["id"], x["name"], x["n"], x["first"]) for x in got) == sorted((i, n, len(v), min(v)) for (i, n), v in want.items())
    assert entities.mentions(df, nf.limit(0)).collect() == []


def test_many_names(spark):
    r = random.Random(10)
    names = [f"n{i} {r.choice('abcdefgh')}{i * 7919 % 100_003}" for i in range(100_000)]
    texts = [(i, " , ".join(r.sample(names, 20)) + " nothing " * 200) for i in range(200)]
    got = entities.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted((x["id"], x["name"]) for x in got) == sorted((i, n) for i, t in texts for n in t.split(" nothing ")[0].split(" , "))
