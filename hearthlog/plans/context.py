"""From a question to the context an answer is made of: seams, routing, facts, assembly, committees (driver side)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import graph, search


@dataclass
class Intent:
    """What a question asks for."""

    people: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    time_periods: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    query_type: str = "general"
    search_query: str = ""
    needs_retrieval: bool = True


def route(question: str, model: Callable[[str], str] | None = None, names: list[str] = ()) -> Intent:
    """L1: a model's JSON as an intent; without one, or where it fails, rules: known names, capitalised words, greetings."""
    if model:
        try:
            found = json.loads(re.search(r"\{.*\}", model(question), re.S)[0])
            return Intent(**{k: v for k, v in found.items() if k in Intent.__dataclass_fields__})
        except (TypeError, ValueError):
            pass
    people = [n for n in names if n.lower() in question.lower()]
    entities = [w for w in re.findall(r"(?<!^)\b[A-Z]\w{2,}", question) if w not in people]
    greeting = bool(re.fullmatch(r"(?i)\s*(?:hi|hello|hey|thanks?|bonjour|salut|merci)[\s!.?]*", question))
    return Intent(people=people, entities=entities, search_query=question, needs_retrieval=not greeting)


def translate(question: str, model: Callable[[str], str] | None = None, to: str = "English") -> str:
    """L1: the question in the language of the archive; without a model, or where it fails or says nothing, as it is."""
    try:
        return (model(f"Translate into {to}, and return only the translation: {question}").strip() if model else "") or question
    except Exception:  # a model server's own errors
        return question


def condense(question: str, context: str, model: Callable[[str], str] | None = None) -> tuple[str, str]:
    """L1: a context cut down to what bears on the question, and a line that says by how much; else the context itself."""
    if not context.strip():
        return "", "empty context"
    try:
        found = model(f"Keep dates, names and numbers. Shorten this context to what answers: {question}\n\n{context}").strip() if model else ""
    except Exception as e:  # a model server's own errors
        return context, f"not condensed: {e}"
    return (found, f"{len(context)} -> {len(found)} characters ({len(found) / len(context) * 100:.1f} %)") if found else (context, "not condensed")


def hashing_embedder(dims: int = 64) -> Callable[[str], Column]:
    """V1: the offline embedder: counts of hashed words, scaled to length one (native)."""
    def embed(text) -> Column:
        slots = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(raw, lambda x: x / F.greatest(norm, F.lit(1e-12)))

    return embed


def gazetteer_entities(text, names: dict[str, list[str]], most: int = 5000) -> Column:
    """M7: the offline recogniser: known names by label."""
    t = F.lower(F.substring(text, 1, most))
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(n.lower())), F.struct(F.lit(label).alias("label"), F.lit(n).alias("name"))) for label, ns in names.items() for n in ns if len(n) >= 2 and not n.isdigit()]))


def stopword_language(text) -> Column:
    """M8: the offline detector: French where more of its stop words are there than English ones."""
    fr = ["le", "la", "les", "des", "est", "une", "que", "pour", "dans", "avec", "pas", "sur"]
    en = ["the", "and", "of", "to", "is", "that", "with", "for", "was", "this", "not", "on"]
    count = lambda ws: F.size(F.filter(tokens(text), lambda w: F.array_contains(F.array(*map(F.lit, ws)), w)))
    return F.when(count(fr) > count(en), "fr").otherwise("en")


def lexicon_emotions(text) -> Column:
    """M4: the offline classifier: shares of emotion words, uniform where there are none."""
    from ..values import EMOTION_WORDS, EMOTIONS

    n = {e: sum((F.when(F.contains(F.lower(text), F.lit(k)), 1.0).otherwise(0.0) for k in EMOTION_WORDS.get(e, [])), F.lit(0.0)) for e in EMOTIONS}
    total = sum(n.values(), F.lit(0.0))
    return F.struct(*[F.when(total > 0, v / total).otherwise(0.2).alias(e) for e, v in n.items()])


def assemble(docs: DataFrame, facts: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """One row with the headed sections of a context."""
    listed = lambda df, c, pos, sep, head: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, c))), lambda s: s[c]), sep).alias("t")).select(F.when(F.col("t") != "", F.concat(F.lit(f"## {head}\n"), "t")).otherwise("").alias("t"))
    parts = [listed(facts, "fact", "pos", "\n", "Facts"), listed(docs, "content", "pos", "\n---\n", "Messages")]
    if episodes is not None:
        parts.insert(1, listed(episodes, "content", "pos", "\n", "Episodes"))
    out = parts[0].select(F.array("t").alias("a"))
    for p in parts[1:]:
        out = out.join(F.broadcast(p)).select(F.concat("a", F.array("t")).alias("a"))  # one row each
    return out.select(F.array_join(F.filter("a", lambda x: x != ""), "\n\n").alias("context"))


def answer_context(corpus: DataFrame, edges: DataFrame, question: str, vector: list[float], names: list[str] = (), n: int = 20, k: int = 5, model=None, **filters) -> DataFrame:
    """V6, V7, G1: the retrieved documents and facts of a question as one context row."""
    i = route(question, model, list(names))
    found = search.hybrid(corpus, i.search_query or question, vector, n, k, search.where(**filters), needs_retrieval=i.needs_retrieval)
    ranked = search.ranked(found, F.desc("rerank_score"), F.desc("rrf_score"), "content", n=k)
    facts = graph.facts(edges, [*i.people, *i.entities] or [question])
    return assemble(ranked, facts)


def committee(question: str, personas: dict[str, str], model: Callable[[str], str], rounds: int = 1) -> str:
    """L1: each persona answers in each round with what was said before; the last call draws it together."""
    said: list[str] = []
    for _ in range(rounds):
        for name, about in personas.items():
            said.append(f"{name}: " + model("\n".join([about, *said, question])))
    return model("\n".join(["Draw these together.", *said, question]))
