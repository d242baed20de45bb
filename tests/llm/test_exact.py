"""Exact duplicates against brute force; fingerprints as a polynomial."""

import random

import numpy as np
import pytest

from hearthlog.llm import exact

from .helpers import DOCS, hard_docs, sha


def brute(rows):
    held: dict = {}
    for i, t in rows:
        held.setdefault(t or "", []).append(i)
    out = []
    for t, ids in held.items():
        ids.sort(key=lambda i: -1 if i is None else i)
        out += [repr((i, ids[-1], len(ids), k == len(ids) - 1, sha(t))) for k, i in enumerate(ids)]
    return sorted(out)


def rows_of(df):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


def fixture(spark):
    r = random.Random(4)
    long = "".join(r.choices("abc é\n", k=150_000))
    rows = hard_docs() + [(20 + k, t, "en", "s", 1, k, "k") for k, t in enumerate([long, long, long[:-1], long + "x", long[: exact.PIECE], long[: exact.PIECE], "\0", "\0\0", "A", "a", "a ", None, "", "abcd", "abcd\0"])]
    return spark.createDataFrame(rows, DOCS).repartition(6), [(x[0], x[1]) for x in rows]


def test_duplicates(spark):
    df, rows = fixture(spark)
    assert rows_of(exact.exact_duplicates(df)) == brute(rows)
    assert exact.exact_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_equal_fingerprints_of_different_texts(spark, monkeypatch, broadcast):
    """With a fingerprint that tells lengths alone, and these badly, classes are split by their bytes."""
    df, rows = fixture(spark)
    same = [(100, "aaaabbbbcccc"), (101, "bbbbaaaacccc"), (102, "aaaabbbbcccc"), (103, "bbbbaaaacccc"), (104, "bbbbaaaacccc"), (101, "aaaabbbbcccc")]
    df = df.select("doc_id", "text").union(spark.createDataFrame(same, "doc_id long, text string"))
    monkeypatch.setattr(exact, "BROADCAST", broadcast)
    monkeypatch.setattr(exact, "piece_prints", lambda buf, off: [np.diff(off).astype(np.uint64) % np.uint64(5)] * 2)
    calls = []
    monkeypatch.setattr(exact, "_verdict", lambda x, f=exact._verdict: calls.append(x) or f(x))
    assert rows_of(exact.exact_duplicates(df)) == brute(rows + same)
    assert len(calls) == 2  # classes were split


def test_fingerprints_combine():
    r = random.Random(1)
    for size in (0, 1, 4, 7, 400, 65536, 200_001):
        t = bytes(r.choices(range(256), k=size))
        words = [int.from_bytes(t[k : k + 4], "little") for k in range(0, size, 4)]
        for j, base in enumerate(exact.BASES):
            want = 0
            for w in words:
                want = (want * base + w) % exact.PRIME
            for piece in (64, 1000, exact.PIECE):
                cuts = [*range(0, size, piece), size]
                share = exact.piece_prints(np.frombuffer(t, np.uint8), np.array(cuts))[j]
                assert sum(exact.shifted(int(h), base, size - end) for h, end in zip(share, cuts[1:])) % exact.PRIME == want
