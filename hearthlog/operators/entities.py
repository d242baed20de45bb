"""All occurrences of many known names in whole texts, in one pass over each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import arrow_limits

#: Names of one automaton, which is sent to all tasks; more names are dealt into several passes.
NAMES = 500_000
#: Occurrences that a task holds before it hands them on, but for those of one text where spans mustn't overlap.
SPANS = 20_000
_HELD: dict = {}


@lru_cache(maxsize=1 << 12)
def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(sent: Broadcast):
    """Built once a worker for each list of names that was sent."""
    held = sent.value
    if held[0] not in _HELD:
        _HELD.clear()
        a = ahocorasick.Automaton()
        for form in held[1]:
            a.add_word(form, form)
        a.make_automaton()
        _HELD[held[0]] = a
    return _HELD[held[0]]


def _apart(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that don't overlap: that which begins first, of those the longest, then on from its end."""
    out, reach = [], 0
    for start, minus, form in sorted((s, -e, f) for s, e, f in spans):
        if start >= reach:
            out.append((start, -minus, form))
            reach = -minus
    return out


def _found(texts: DataFrame, forms: DataFrame, borders: bool, apart: bool) -> DataFrame | None:
    """(id, start, end, form) of texts (id, text in lower case)."""
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    arrow_limits(spark)
    schema = f"id {kind}, start long, end long, form string"
    groups = max(1, -(-forms.count() // NAMES))

    def table(rows):
        return pd.DataFrame(rows, columns=["id", "start", "end", "form"]).astype({"start": "int64", "end": "int64"})

    def spans(a, t):
        for last, form in a.iter(t):
            start, end = last - len(form) + 1, last + 1
            if not borders or not ((start and _word(t[start - 1]) and _word(t[start])) or (end < len(t) and _word(t[end]) and _word(t[last]))):
                yield start, end, form

    def walk_with(sent):
        def walk(frames):
            a = _automaton(sent)
            for f in frames:
                out = []
                for i, t in zip(f["id"], f["text"]):
                    for span in _apart(spans(a, t or "")) if apart and groups == 1 else spans(a, t or ""):
                        out.append((i, *span))
                        if len(out) == SPANS:
                            yield table(out)
                            out = []
                yield table(out)

        return walk

    found = None
    for g in range(groups):  # the driver holds one group of names at a time
        part = [r["form"] for r in forms.filter(F.pmod(F.xxhash64("form"), F.lit(groups)) == g).collect()]
        if part:
            x = texts.mapInPandas(walk_with(spark.sparkContext.broadcast((uuid.uuid4().hex, part))), schema)
            found = x if found is None else found.unionByName(x)
    if not apart or groups == 1 or found is None:
        return found

    def choose(frame):
        rows = _apart(list(zip(frame["start"], frame["end"], frame["form"])))
        out = pd.DataFrame(rows, columns=["start", "end", "form"]).astype({"start": "int64", "end": "int64"})
        out.insert(0, "id", frame["id"].iloc[0])
        return out

    return found.groupBy("id").applyInPandas(choose, schema)


def mentions(texts: DataFrame, names: DataFrame, id_: str = "id", text: str = "text", name: str = "name", borders: bool = True, apart: bool = False) -> DataFrame:
    """(id, name, start, end) of every occurrence of a name, in any case.

    borders: an occurrence has no letter, digit or `_` beside one of its own. apart: of overlapping occurrences the one
    that begins first counts, of those the longest (ids are unique then). Positions are those in the lower-cased text.
    Names that differ in case only are reported each; null or blank names and null texts give none. An automaton over
    the names (Aho-Corasick) is walked once per text, so the work grows with the texts and with what is found.
    """
    named = names.select(F.col(name).alias("name")).filter(F.trim("name") != "").distinct().withColumn("form", F.lower("name"))
    x = texts.select(F.col(id_).alias("id"), F.lower(text).alias("text"))
    found = _found(x, named.select("form").distinct(), borders, apart)
    if found is None:
        return x.limit(0).select("id", F.lit("").alias("name"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return found.join(named, "form").select("id", "name", "start", "end")


def entities(texts: DataFrame, names: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """M7: (id, label, name, n, first) of known names (label, name) in whole texts; occurrences don't overlap."""
    m = mentions(texts, names, id_, text, apart=True)
    one = m.groupBy("id", "name").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    return one.join(names.select("label", "name").distinct(), "name").select("id", "label", "name", "n", "first")


def first_mention(questions: DataFrame, names: DataFrame) -> DataFrame:
    """J7 on many names: for each question (q, text) the known name (name, pos) that it holds as whole words and whose
    pos is least; questions without one give no row."""
    m = mentions(questions, names, "q", "text").select("id", "name").distinct()
    return m.join(names.groupBy("name").agg(F.min("pos").alias("pos")), "name").groupBy(F.col("id").alias("q")).agg(F.min_by("name", F.struct("pos", "name")).alias("name"))
