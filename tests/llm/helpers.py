"""Small tables that every operator has to stand, and brute-force versions."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, `key` string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def hard_docs():
    """Nulls everywhere, empty and blank texts, a very long one, ties, repeated rows; columns with clashing names."""
    r = random.Random(5)
    words = [f"{r.choice('bcdfgklmn')}{r.choice('aeiou')}{r.choice('rstlm')}{i}" for i in range(400)]
    body = " ".join(r.choices(words, k=120))
    near = body.split()
    near[60] = "changed"
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, " \n\t", "en", "s", 3), (4, body, "en", "s", 1), (5, body, "en", "s", 1), (6, " ".join(near), "fr", None, 1),
        (7, "One two", "en", "s", 7), (8, "one TWO", "en", "s", 7), (9, " ".join(r.choices(words, k=20000)), "en", "s", None), (10, "x" * 5000, "en", "t", 5000),
        (11, "mail a.b@c.de or +1 (583) 555-8469 from 10.0.0.1 é 4111111111111111 \x01 z@q.r", "en", "s", 1), (11, "mail a.b@c.de or +1 (583) 555-8469 from 10.0.0.1 é 4111111111111111 \x01 z@q.r", "en", "s", 1),
        (12, ("la la la la " * 40).strip(), "en", "s", 1), (13, "\n".join(["same line here"] * 30), "en", "s", 1), (None, "without id " + body[:200], "en", "s", 1),
    ]
    return [(*x, i, "k") for i, x in enumerate(rows)]


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
