"""Clustering and hard negatives against brute force in Python's integers, on tables with every odd case."""

import hashlib
import math
import random

import numpy as np
import pytest

from hearthlog.llm import clustering, negatives, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, n long, cluster string, score double"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "c", 0.5) for r in rows], schema)


def hard_rows(dim, seed=1, n=160, big=()):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1, -0.5, 0, 0.25, 0.7]) * r.random() for _ in range(dim)], r.randint(0, 3)) for i in range(n)]
    rows += [(200, None, 1), (201, [0.1] * (dim - 1) + [None], 1), (202, [0.1] * (dim - 1) + [math.nan], 1), (203, [math.inf] + [0.1] * (dim - 1), 1), (204, [], 1), (None, rows[3][1], rows[3][2]), (None, None, None)]
    rows += [rows[50], rows[50], rows[7], (300, rows[50][1], rows[50][2]), (350, rows[100][1], 9), (400, [0.0] * dim, None), (450, [0.0] * dim, 1)]
    return rows + [(500 + k * 50, [v * (-1) ** i for i in range(dim)], k % 2) for k, v in enumerate(big)]


def cap(v):
    return min(v, vectors.LONG)


def lloyd(rows, k=8, rounds=10, scale=1024, dim=64, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // own.count(j) for x in zip(*[v for (_, v), o in zip(kept, own) if o == j])] if j in own else c[j] for j in range(len(c))]
    got = [near(v) for _, v in kept]
    cost = [sum(d for d, j in got if j == m) for m in range(len(c))]
    return sorted((str(i), j, cap(d), cap(cost[j]), cap(sum(cost)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got))


@pytest.mark.parametrize("big", [(), (3e4, 3.1e4, -2e6), (1e12, 1e30, 1.7e38)])
def test_clusters(spark, big):
    rows = hard_rows(64, big=big)
    got = clustering.centroid_clusters(table(spark, rows).repartition(5)).collect()
    assert sorted((str(r["vec_id"]), *r[1:]) for r in got) == lloyd(rows)


def test_few_vectors_and_none(spark):
    few = hard_rows(64)[:5]
    assert sorted((str(r["vec_id"]), *r[1:]) for r in clustering.centroid_clusters(table(spark, few)).collect()) == lloyd(few)
    assert clustering.centroid_clusters(table(spark, [])).collect() == []
    assert clustering.centroid_clusters(table(spark, [(1, None, 1), (2, [0.5], 1)])).collect() == []
    assert negatives.hard_negatives(table(spark, [])).collect() == []
    assert negatives.hard_negatives(table(spark, [(50, None, 1), (100, [0.5], None)])).collect() == []
    assert negatives.hard_negatives(table(spark, [(50, [0.5], 1), (51, [0.5], 2)])).collect() == []


def test_distances_at_the_bound():
    for v in (1000.0, 2.0**23, 2.0**24, 2.0**40):
        x = np.array([[v, -v], [v - 1, v], [1 - v, 0]])
        c = [[int(v), int(-v) + 1], [0, 3]]
        d = clustering.distances(x, c)
        assert [[int(y) for y in row] for row in d] == [[sum((int(a) - b) ** 2 for a, b in zip(r, m)) for m in c] for r in x.tolist()]


def mine(rows, scale=256, every=50, positives=5, negs=3):
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-vectors.LONG - 1, min(vectors.LONG, sum(x * y for x, y in zip(a, b))))
    anchors = {(i, tuple(v), y) for i, v, y in kept if i is not None and i % every == 0}
    out = []
    for i, v, y in anchors:
        order = sorted((-dot(v, w), math.inf if j is None else j, z) for j, w, z in kept if j != i)
        name = lambda j: None if j == math.inf else j
        for p, j, _ in [o for o in order if o[2] == y][:positives]:
            inside = [o for o in order if o[2] != y and 50 * -p <= 100 * -o[0] <= 95 * -p][:negs]
            out += [(i, name(j), k + 1, name(o[1]), -p, -o[0]) for k, o in enumerate(inside)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("dim,big", [(7, ()), (64, ()), (12, (1e3, 4e3, 5e3)), (8, (1e5, 2e6, 1e7, 1.5e7)), (4, (1e25, 1e25, 2e25))])
def test_hard_negatives(spark, monkeypatch, dim, big):
    monkeypatch.setattr(negatives, "GROUP", 2)
    rows = hard_rows(dim, seed=dim, n=300, big=big)
    got = negatives.hard_negatives(table(spark, rows).repartition(5)).collect()
    want = mine(rows)
    assert sorted(repr(tuple(r)) for r in got) == want and len(want) > 20


def test_hard_negatives_in_passes(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = hard_rows(9, n=400)
    assert sorted(repr(tuple(r)) for r in negatives.hard_negatives(table(spark, rows).repartition(3), every=50).collect()) == mine(rows)


def test_bounds_drop_pairs_but_none_inside():
    """With leading components that carry most of a product few pairs stay open, and no pair above the bound is lost."""
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 64))
    x = np.floor(256 * (r.normal(size=(500, 6)) @ base + 0.02 * r.normal(size=(500, 64))))
    a = x[:20]
    turn = negatives.Turn(np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1]), [16, 32, 48, 64], 1e-10)
    block = lambda v: negatives.side({"data": v.tobytes(), "kind": "<f8", "n": len(v), "width": 64, "ids": np.arange(len(v)).astype("<i8").tobytes(), "labels": np.zeros(len(v), "<i8").tobytes()}, turn)
    exact = a @ x.T
    low = np.sort(exact, axis=1)[:, -5]
    i, j = negatives.open_pairs(block(a), block(x), turn, low, np.full(20, np.inf), np.ones(exact.shape, bool))
    found = set(zip(i.tolist(), j.tolist()))
    assert {(p, q) for p, q in zip(*np.nonzero(exact >= low[:, None]))} <= found
    assert len(found) < 150
    assert negatives.scores(block(a), block(x), i, j).tolist() == exact[i, j].astype(int).tolist()
