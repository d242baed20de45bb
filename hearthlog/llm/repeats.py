"""Removal of repeated passages: every byte covered by a 400-byte string that starts anywhere else too.

Longest previous factors, distributed. For a string that starts at a position, the longest earlier match is that
with one of two neighbours in suffix order: the nearest one before it with a smaller position, or the nearest one
after it. Whether a factor reaches LENGTH bytes is all that matters here, so suffixes are compared up to LENGTH
bytes and values are capped there. keep="first" removes the positions whose previous factor reaches LENGTH, that is
later copies; keep="none" also removes the copies that those factors refer to.

1. Texts with equal bytes are one unit; with several copies, each copy repeats the others.
2. Each window of LENGTH bytes has a mark, the least hash of its GRAM-byte strings. Equal windows have equal
   marks, neighbouring windows mostly share theirs, so a text is a few runs (mark, first, last start). Only
   runs whose mark occurs in another run, or twice within, go on; marks are counted with pre-aggregation.
3. The bytes of these runs are dealt by mark, packed, into parts of bounded size, so that all suffixes with equal
   first LENGTH bytes meet. A part drops suffixes whose fingerprint is alone, compares the others byte by byte,
   puts them into suffix order, and takes the previous factors from it in one pass with a stack.
   Marks with very many bytes (HOT) are split further: their windows are dealt by their own fingerprints, after
   equal ones of a batch have become one with a count; they are compared by 128 bits, mark and fingerprint.
4. Intervals are merged for each unit and the remaining bytes hashed.

The same steps over texts as words of two bytes each (16 bits of a hash) find passages of more than 50 words that
another text holds too, of any number of bytes; n_passages counts them, each where it first occurs in its text.

Defined cases: null text is empty; texts under LENGTH bytes keep all; repeated rows are copies of each other;
a null id stands after all others, its text is judged like any; texts of any length are whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, hash_words, mix, pieces, settle, text_bytes, words


class Grain(NamedTuple):
    """Length of the strings that count as repeated, and of the strings within that marks are taken from, in bytes."""

    length: int
    gram: int


#: 400 bytes; and 51 words of two bytes.
BYTES, WORDS = Grain(400, 64), Grain(102, 16)
#: Bytes of runs a part holds, about, and bytes of one mark's runs beyond which windows are dealt singly.
PART, HOT = 3 << 20, 6 << 20
RUNS, WINDOWS, REPORTED = 0, 1, 2
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_LAST = (1 << 63) - 1


def prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the fingerprint of any substring, and the inverse powers for it."""
    n = len(buf)
    power = np.ones(n + 1, np.uint64)
    power[1:] = BASE
    np.multiply.accumulate(power, out=power)
    back = np.ones(n + 1, np.uint64)
    back[1:] = pow(BASE, -1, 1 << 64)
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[buf] * power[:-1], out=total[1:])
    return total, back


def prints(total: np.ndarray, back: np.ndarray, start: np.ndarray | slice, length: int) -> np.ndarray:
    if isinstance(start, slice):
        return mix((total[length:] - total[:-length]) * back[: len(back) - length])
    return mix((total[start + length] - total[start]) * back[start])


def least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by minima of blocks from either side."""
    n = len(g) - width + 1
    size = -(-len(g) // width) * width
    x = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    x[: len(g)] = g
    x = x.reshape(-1, width)
    up = np.minimum.accumulate(x, axis=1).reshape(-1)
    down = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def runs(buf: np.ndarray, off: np.ndarray, grain: Grain):
    """(text, mark, first, last, twice): runs of window starts with one mark; twice: the mark is there more than once."""
    size, width = np.diff(off), grain.length - grain.gram + 1
    if not (size >= grain.length).any():
        return [np.zeros(0, np.int64)] * 5
    g = prints(*prefix(buf), slice(None), grain.gram)
    m = least(g, width)  # windows over a text's end are dropped below
    start = np.arange(len(m))
    doc = np.repeat(np.arange(len(size)), size)[: len(m)]
    good = start + grain.length <= off[doc + 1]
    new = good.copy()
    new[1:] &= ~(good[:-1] & (m[1:] == m[:-1]) & (doc[1:] == doc[:-1]))
    first = np.flatnonzero(new)
    ends = good.copy()
    ends[:-1] &= ~(good[1:] & (m[1:] == m[:-1]) & (doc[1:] == doc[:-1]))
    last = np.flatnonzero(ends)
    mark = m[first]
    names = np.unique(mark)
    at = np.minimum(np.searchsorted(names, g), len(names) - 1)
    pos = np.flatnonzero(names[at] == g)
    key = np.sort(at[pos] * len(buf) + pos)
    own = np.searchsorted(names, mark) * len(buf)
    twice = np.searchsorted(key, own + last + width) - np.searchsorted(key, own + first) > 1
    d = doc[first]
    return d, mark.view(np.int64), first - off[d], last - off[d], twice


# --- longest previous factors of chosen suffixes of a text


def _steps(length: int) -> list[int]:
    """Offsets of the 8-byte words that cover a string; the last one may overlap the one before it."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def _view(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number that orders like them."""
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))


def _unequal(view: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Where the strings at a and at b differ, byte by byte; where the pair one byte before is equal, one byte tells."""
    rank = np.lexsort((b, a))
    x, y = a[rank], b[rank]
    goes_on = np.append(False, (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1))
    goes_on &= view[x + length - 8] & _U(255) == view[y + length - 8] & _U(255)
    out = np.zeros(len(a), bool)
    for todo in (np.flatnonzero(~goes_on), np.flatnonzero(goes_on)):
        i = rank[todo]
        for s in _steps(length):
            out[i] |= view[a[i] + s] != view[b[i] + s]
        if not out.any():  # all starts are equal, so all that go on from them
            break
    return out


def classes(view: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, class): those of the strings at `at` that equal another one, by class, then position; h: their fingerprints."""
    by = np.argsort(h, kind="stable")
    equal = h[by][1:] == h[by][:-1]
    by = by[np.append(equal, False) | np.append(False, equal)] if len(by) else by
    if not len(by):  # a mark is shared, a whole string isn't
        return by, by
    name = np.cumsum(np.append(True, h[by][1:] != h[by][:-1])) - 1
    lead = by[np.searchsorted(name, np.arange(name[-1] + 1))]
    other = _unequal(view, at[by], at[lead[name]], length)
    if other.any():  # equal fingerprints of different strings
        own: dict = {}
        for k in np.flatnonzero(other):
            key = (name[k], *[int(view[at[by[k]] + s]) for s in _steps(length)])
            name[k] = own.setdefault(key, len(lead) + len(own))
        rank = np.lexsort((by, name))
        by, name = by[rank], np.unique(name[rank], return_inverse=True)[1]
        n = np.bincount(name)
        by, name = by[n[name] > 1], name[n[name] > 1]
        name = np.unique(name, return_inverse=True)[1] if len(name) else name
    return by, name


def suffix_order(view: np.ndarray, at: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings at `at`, and how many of `length` bytes each shares with the one before it in that order.

    at is sorted by class (name) and position; strings of a class are equal, so one of each is compared, and the others
    stand behind it by position.
    """
    begin = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
    size = np.diff(np.append(begin, len(name)))
    by, first = _order_of_different(view, at[begin], length)
    n = size[by]
    start = np.cumsum(n) - n
    order = np.repeat(begin[by] - start, n) + np.arange(len(name))
    shared = np.full(len(name), length)
    shared[start] = first
    return order, shared


def _order_of_different(view: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for strings that all differ."""
    by = np.argsort(view[at], kind="stable")
    new = np.append(True, view[at[by]][1:] != view[at[by]][:-1])
    for s in _steps(length)[1:]:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        group, word = (np.cumsum(new) - 1)[tied], view[at[by[tied]] + s].astype(np.uint64)
        rank = np.lexsort((word, group))
        by[tied], word = by[tied][rank], word[rank]
        new[tied[1:]] |= (word[1:] != word[:-1]) & (group[1:] == group[:-1])
    shared, open_ = np.zeros(len(at), np.int64), np.arange(1, len(at))
    for s in _steps(length):
        x = view[at[by[open_]] + s].astype(np.uint64) ^ view[at[by[open_ - 1]] + s].astype(np.uint64)
        apart = x != 0
        shared[open_[apart]] = s + sum((x[apart] < _U(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        open_ = open_[~apart]
    return by, shared


def previous_factors(order: np.ndarray, shared: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, source) by place in suffix order: the longest match, up to `most` bytes, with a smaller position, and that
    position's place (-1: none).

    order: the positions in suffix order; shared: bytes each shares with the one before. A longest match is that with
    the previous smaller position or the next smaller one. Where the place just before has a smaller position and
    shares `most` bytes, it is the previous smaller one and nothing can be longer. The other places go through a stack
    with growing positions: below a place lies its previous smaller one; the place that takes it off is the next smaller.
    """
    n = len(order)
    value, source = np.zeros(n, np.int64), np.full(n, -1)
    full = np.append(False, (order[:-1] < order[1:]) & (shared[1:] >= most))[:n]
    value[full], source[full] = most, np.flatnonzero(full) - 1
    rest = np.flatnonzero(~full)
    stack: list = []  # places, and what each shares with the one below
    places = zip(rest.tolist(), shared[rest].tolist(), order[rest].tolist())
    for k, common, p in [*places, (n, 0, -1)]:
        # a place left out lies above the one before it, shares all with it and has a greater position: it can be neither
        # the nearest smaller position of a place that is not, nor what limits a match
        while stack and order[stack[-1][0]] > p:
            at, with_last = stack.pop()
            if with_last >= common:
                value[at], source[at] = with_last, stack[-1][0] if stack else -1
            else:
                value[at], source[at] = common, k
            common = min(common, with_last)
        if k < n:
            stack.append((k, common if stack else 0))
    return value, source


def repeated(buf: np.ndarray, at: np.ndarray, h: np.ndarray, length: int, keep: str, owner: np.ndarray) -> np.ndarray:
    """Which of the strings at `at`, given in order of position, are to go.

    keep: "first" removes those that have an earlier match, "none" all that have another, "alone" those that
    another owner's text has too (of equal ones of a text the first).
    """
    view, out = _view(buf), np.zeros(len(at), bool)
    who, name = classes(view, at, h, length)
    if not len(who):
        return out
    begin = np.searchsorted(name, np.arange(name[-1] + 1))
    if keep == "alone":
        o = owner[who]
        both = (np.minimum.reduceat(o, begin) != np.maximum.reduceat(o, begin))[name]
        out[who] = both & np.append(True, (o[1:] != o[:-1]) | (name[1:] != name[:-1]))
        return out
    rank, shared = suffix_order(view, at[who], name, length)
    place = who[rank]  # positions in suffix order, as numbers in order of position
    value, source = previous_factors(place, shared, length)
    long = value >= length
    out[place[long]] = True
    if keep == "none":
        out[place[source[long]]] = True
    return out


# --- dealing runs into parts


def _pack(mark, unit, owner, first, size, data) -> bytes:
    return b"".join([np.array([len(mark), len(data)], "<i8").tobytes(), mark.astype("<i8").tobytes(), b"".join(unit), owner.astype("<i8").tobytes(), first.astype("<i8").tobytes(), size.astype("<i8").tobytes(), data.tobytes()])


def _unpack(blob: bytes):
    n, size = np.frombuffer(blob, "<i8", 2)
    at, out = 16, []
    for kind, width in (("<i8", 8), ("V16", 16), ("<i8", 8), ("<i8", 8), ("<i8", 8)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += width * n
    return (*out, np.frombuffer(blob, np.uint8, size, at))


def _covered(row, start, repeated, length):
    """(unit row, from, to) of the bytes that repeated windows cover; windows sorted by row and start."""
    row, start = row[repeated], start[repeated]
    if not len(row):
        return row, start, start
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(row) - 1)
    return row[first], start[first], start[last] + length


def _same(unit: np.ndarray) -> np.ndarray:
    """A number for each unit, the same for the same one."""
    return np.unique(unit.view("<u8").reshape(-1, 2).view([("a", "<u8"), ("b", "<u8")]).reshape(-1), return_inverse=True)[1]


def _once(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def intervals(keyed: DataFrame, parts: int, keep: str, grain: Grain) -> DataFrame:
    """(unit, a, b) from units (unit, owner, text, runs)."""
    blob = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("lists", pa.binary())])
    out = pa.schema([("unit", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
    length = grain.length

    def spread(batches):
        for b in batches:
            for p in pieces(b, "text", 2 << 20):
                held: dict[int, list] = {}
                for unit, owner, text, rs in zip(*(p.column(c).to_pylist() for c in ("unit", "owner", "text", "runs"))):
                    share = mix(np.array([r["mark"] for r in rs], np.int64).view(np.uint64).copy()) % _U(parts)
                    for r, k in zip(rs, share.tolist()):
                        held.setdefault(-1 if r["hot"] else k, []).append((r["mark"], unit, _LAST if owner is None else owner, r["first"], text[r["first"] : r["last"] + length]))
                for k, rows in held.items():
                    mark, unit, owner, first, data = zip(*rows)
                    buf = np.frombuffer(b"".join(data), np.uint8)
                    size = np.array([len(d) for d in data])
                    if k >= 0:
                        yield pa.RecordBatch.from_pydict({"part": [k], "kind": [RUNS], "lists": [_pack(np.array(mark), unit, np.array(owner), np.array(first), size, buf)]}, schema=blob)
                        continue
                    yield from _single(np.array(mark), unit, np.array(owner), np.array(first), size, buf, parts, keep, length, blob)

    def order(key, table):
        kinds = np.array(table.column("kind"))
        found = [f(*(np.concatenate(c) for c in zip(*[_unpack(x.as_py()) for x, k in zip(table.column("lists"), kinds) if k == kind]))) for kind, f in ((RUNS, by_run), (WINDOWS, by_window), (REPORTED, lambda mark, unit, owner, first, size, buf: (unit, first, first + size))) if (kinds == kind).any()]
        unit, a, b = (np.concatenate(c) for c in zip(*found))
        return pa.Table.from_arrays([pa.array([x.tobytes() for x in unit], pa.binary()), pa.array(a), pa.array(b)], schema=out)

    def by_window(mark, unit, owner, first, size, buf):
        h, who = buf.view("<u8"), _same(unit)
        by = np.lexsort((first, who, owner, mark, h))
        by = by[_once(h[by], mark[by], who[by], first[by])]  # repeated rows are one
        new = np.append(True, (h[by][1:] != h[by][:-1]) | (mark[by][1:] != mark[by][:-1]))
        begin = np.flatnonzero(new)
        if keep == "first":
            gone = ~new
        elif keep == "alone":
            gone = (np.minimum.reduceat(who[by], begin) != np.maximum.reduceat(who[by], begin))[np.cumsum(new) - 1] & (new | np.append(True, who[by][1:] != who[by][:-1]))
        else:
            gone = (np.add.reduceat(size[by], begin) > 1)[np.cumsum(new) - 1]
        by = by[gone]
        return unit[by], first[by], first[by] + length

    def by_run(mark, unit, owner, first, size, buf):
        begin, who = np.cumsum(size) - size, _same(unit)
        # in order of position; the same run twice (repeated rows) is one run
        rank = np.lexsort((first, who, owner))
        same = np.append(False, (mark[rank][1:] == mark[rank][:-1]) & (who[rank][1:] == who[rank][:-1]) & (first[rank][1:] == first[rank][:-1]))
        rank = rank[~same]
        unit, who, first, size, begin = (x[rank] for x in (unit, who, first, size, begin))
        n = size - length + 1
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[row] + inner
        gone = repeated(buf, at, prints(*prefix(buf), at, length), length, keep, who[row])
        r, a, b = _covered(row, first[row] + inner, gone, length)
        return unit[r], a, b

    dealt = keyed.mapInArrow(spread, "part int, kind int, lists binary")
    return dealt.groupBy("part").applyInArrow(order, "unit binary, a long, b long")


def _single(mark, unit, owner, first, size, buf, parts, keep, length, schema):
    """Windows dealt by fingerprint: of equal ones the first with their number; the others are reported at once."""
    begin, n = np.cumsum(size) - size, size - length + 1
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = first[row] + inner
    h = prints(*prefix(buf), begin[row] + inner, length)
    who = _same(np.frombuffer(b"".join(unit), "V16"))[row]
    by = np.lexsort((start, who, owner[row], h))
    by = by[_once(h[by], who[by], start[by])]
    new = np.append(True, h[by][1:] != h[by][:-1])
    lead = by[new]
    count = np.diff(np.append(np.flatnonzero(new), len(by)))
    done = np.zeros(len(h), bool)
    if keep == "alone":
        begin = np.flatnonzero(new)
        both = np.minimum.reduceat(who[by], begin) != np.maximum.reduceat(who[by], begin)
        done[by[both[np.cumsum(new) - 1] & (new | np.append(True, who[by][1:] != who[by][:-1]))]] = True
    else:
        done[by[~new]] = True
        if keep == "none":
            done[lead[count > 1]] = True
    r, a, z = _covered(row, start, done, length)
    if len(r):
        none = np.zeros(len(r), np.int64)
        yield pa.RecordBatch.from_pydict({"part": [int(h[0] % _U(parts))], "kind": [REPORTED], "lists": [_pack(none, [unit[x] for x in r], none, a, z - a, np.zeros(0, np.uint8))]}, schema=schema)
    part = (h[lead] % _U(parts)).astype(np.int64)
    for k in np.unique(part):
        at, c = lead[part == k], count[part == k]
        yield pa.RecordBatch.from_pydict({"part": [int(k)], "kind": [WINDOWS], "lists": [_pack(mark[row[at]], [unit[x] for x in row[at]], owner[row[at]], start[at], c, h[at].view(np.uint8))]}, schema=schema)


def marked(docs: DataFrame, grain: Grain) -> DataFrame:
    """(unit, mark, first, last, twice) of each text's runs."""
    schema = pa.schema([("unit", pa.binary()), ("mark", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("twice", pa.bool_())])

    def run(batches):
        for b in batches:
            for p in pieces(b, "text", 2 << 20):
                d, mark, first, last, twice = runs(*buffers(p.column("text")), grain)
                units = p.column("unit").take(pa.array(d)) if len(d) else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([units.cast(pa.binary()), pa.array(mark, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(twice, pa.bool_())], schema=schema)

    return docs.mapInArrow(run, "unit binary, mark long, first long, last long, twice boolean")


def word_codes(column: pa.Array) -> pa.Array:
    """Each text as its words, two bytes of a hash for each."""
    buf, off = buffers(column)
    start, end = words(buf, off)
    code = (hash_words(buf, start, end, lower=False) >> _U(48)).astype("<u2").tobytes()
    ends = 2 * np.searchsorted(start, off)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(code)]).cast(pa.binary())


def _name(c):
    """128 bits of a text's digest."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def found(texts: DataFrame, own: DataFrame, grain: Grain, keep: str, name: str) -> DataFrame:
    """Of the units (owner doc_id, unit, text) the ranges to go: unit, owner, copies, and of their text removed, n, digest, spans.

    texts: (doc_id, unit, text); own: (doc_id, unit) of the same rows. Units with one copy and no range are left out.
    """
    units = own.groupBy("unit").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    marks = settle(marked(texts.select("unit", "text"), grain), f"{name}-runs").distinct()
    bytes_ = F.sum(F.col("last") - F.col("first") + grain.length)
    often = marks.groupBy("mark").agg(F.count("*").alias("c"), F.max("twice").alias("t"), bytes_.alias("s")).filter("c > 1 or t").select("mark", (F.col("s") > HOT).alias("hot"))
    live = marks.join(often, "mark").groupBy("unit").agg(F.collect_list(F.struct("mark", "first", "last", "hot")).alias("runs"))
    live = settle(live.join(units.select(F.col("unit").alias("u"), "owner"), F.col("unit") == F.col("u")).drop("u"), f"{name}-live")
    # by id first: of a text with very many copies one is taken, and no task gets them all
    l = live.withColumnRenamed("unit", "u")
    rest = texts.join(l, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("unit") == F.col("u"))).select("unit", "owner", "text", "runs")
    rest = settle(rest, f"{name}-repeats")
    size = rest.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + grain.length))).first()[0] or 0
    spans = intervals(rest, max(8, -(-size // PART)), keep, grain).groupBy("unit").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = settle(_apply(rest.select("unit", "text").dropDuplicates(["unit"]).join(spans, "unit")), f"{name}-kept")
    return units.join(cut, "unit", "left").filter("copies > 1 or n is not null")


def remove_repeats(docs: DataFrame, keep: str = "none", texts: bool = False, passages: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and n_passages if asked for.

    If texts: also spans, the removed ranges as bounds in turn, and all_removed.
    """
    arrow_limits(docs.sparkSession)
    body = docs.select("doc_id", text_bytes(F.col("text").cast("string")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("codes", pa.binary())])

    def coded(batches):
        for b in batches:
            for p in pieces(b, "text"):
                yield pa.RecordBatch.from_arrays([p.column("doc_id").cast(pa.int64()), p.column("n_bytes"), p.column("sha"), word_codes(p.column("text"))], schema=schema)

    own = body.select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "text")
    own = own.mapInArrow(coded, "doc_id long, n_bytes long, sha string, codes binary") if passages else own.withColumn("codes", F.lit(b""))
    own = settle(own.select("doc_id", "n_bytes", "sha", F.substring(F.unhex("sha"), 1, 16).alias("unit"), F.substring(F.unhex(F.sha2("codes", 256)), 1, 16).alias("unit2"), "codes"), "texts")
    done = found(body.withColumn("unit", _name(F.col("text"))), own.select("doc_id", "unit"), BYTES, keep, "bytes")
    x = own.drop("codes").join(done, "unit", "left")
    if keep == "first":  # of equal rows with the first id one stays
        w = Window.partitionBy("unit", "doc_id").orderBy("n_bytes")
        x = x.withColumn("__later", ~F.col("doc_id").eqNullSafe(F.col("owner")) | (F.row_number().over(w) > 1))
    else:
        x = x.withColumn("__later", F.lit(True))
    whole = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= BYTES.length) & F.col("__later")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    x = x.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
                 F.when(whole, empty).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"), "spans", whole.alias("all_removed"), "unit2")
    if passages:
        said = found(own.select("doc_id", F.col("unit2").alias("unit"), F.col("codes").alias("text")), own.select("doc_id", F.col("unit2").alias("unit")), WORDS, "alone", "words")
        size = own.groupBy("unit2").agg(F.max(F.length("codes")).alias("size"))
        said = said.join(size, F.col("unit") == F.col("unit2")).select("unit2", F.when((F.col("copies") > 1) & (F.col("size") >= WORDS.length), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_passages"))
        x = x.join(said, "unit2", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0).cast("long")))
    out = x.drop("unit2")
    return out if texts else out.drop("spans", "all_removed")


def _apply(units: DataFrame) -> DataFrame:
    schema = pa.schema([("unit", pa.binary()), ("removed", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for unit, text, spans in zip(*(b.column(c).to_pylist() for c in ("unit", "text", "spans"))):
                merged: list[list[int]] = []
                for a, z in sorted((s["a"], s["b"]) for s in spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                cuts = [0, *[x for m in merged for x in m], len(text)]
                kept = b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                rows.append({"unit": unit, "removed": len(text) - len(kept), "n": len(merged), "digest": hashlib.sha256(kept).hexdigest(), "spans": [x for m in merged for x in m]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return units.mapInArrow(run, "unit binary, removed long, n long, digest string, spans array<long>")
