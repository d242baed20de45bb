"""Column functions on texts: cleaning, classification, keywords, parsing (all native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V

EMOJI_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in V.EMOJI)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squash(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def words(c) -> Column:
    """Pieces between white space."""
    return F.array_remove(F.split(_c(c), r"\s+"), "")


def word_count(c) -> Column:
    return F.size(words(c))


def tokens(c) -> Column:
    return words(F.lower(_c(c)))


def chat_timestamp(c) -> Column:
    """`Jun 18, 2015 9:35:16 pm`; null where it is something else."""
    return F.try_to_timestamp(F.trim(_c(c)), F.lit("MMM d, yyyy h:mm:ss a"))


def activity_timestamp(c) -> Column:
    """ISO, or `Jun 3, 2018, 7:00:34 PM`, else the epoch."""
    return F.coalesce(F.try_to_timestamp(F.trim(_c(c)), F.lit("MMM d, yyyy, h:mm:ss a")), F.try_to_timestamp(_c(c)), F.lit("1970-01-01 00:00:00").cast("timestamp"))


def partial_date(c) -> Column:
    """`Sep 2025` and `2025` become the first of the month, present ones empty, others stay."""
    t = F.trim(_c(c))
    found = F.coalesce(F.try_to_timestamp(t, F.lit("MMM yyyy")), F.when(t.rlike("^[0-9]{4}$"), F.try_to_timestamp(t, F.lit("yyyy"))))
    return F.when(F.lower(t).isin("present", "now", ""), "").otherwise(F.coalesce(F.date_format(found, "yyyy-MM-dd"), t))


def day_month_year(c) -> Column:
    """`03 Jan 2026` to ISO; unknown months are 00, other shapes stay."""
    p = F.split(F.trim(_c(c)), r"\s+")
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()) for x in (m, f"{i + 1:02d}")])
    return F.when(F.size(p) == 3, F.concat_ws("-", F.get(p, 2), F.coalesce(months[F.get(p, 1)], F.lit("00")), F.lpad(F.get(p, 0), 2, "0"))).otherwise(_c(c))


def strip(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def halves_equal(c) -> Column:
    t = _c(c)
    half = (F.length(t) / 2).cast("int")
    return strip(F.substring(t, F.lit(1), half)) == strip(F.substring(t, half + 1, F.length(t)))


def reaction_duplicate(c, shortest: int = 6, least: int = 2) -> Column:
    """P5: a text that says the same twice is said once, up to the first emoji where enough remains."""
    t = _c(c)
    first = strip(F.substring(t, F.lit(1), (F.length(t) / 2).cast("int")))
    before = strip(F.regexp_replace(first, f"(?s)[{EMOJI_CLASS}].*$", ""))
    return F.when((F.length(t) < shortest) | ~halves_equal(t), t).when(F.length(before) >= least, before).otherwise(first)


def persona_text(c) -> Column:
    """Without trailing address and audio marks, duplicates of over 15 characters once."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"(?i)\s*IP Address:.*$", ""), r"(?i)\s*Click for audio\s*$", ""))
    first = strip(F.substring(t, F.lit(1), (F.length(t) / 2).cast("int")))
    before = strip(F.regexp_replace(first, f"(?s)[{EMOJI_CLASS}].*$", ""))
    return F.when((F.length(first) > 15) & halves_equal(t), F.when(F.length(before) >= 10, before).otherwise(first)).otherwise(t)


def message_type(c) -> Column:
    """System before reaction before text."""
    t = _c(c)
    starts = lambda p: t.rlike("(?i)^(?:" + "|".join(p) + ")")
    return F.when(starts(V.SYSTEM_STARTS), "system").when(starts(V.REACTION_STARTS), "reaction").otherwise("text")


#: A name: one to six words that begin with a capital, with a space or hyphen between them; and the time of a reaction.
NAME = r"\p{Lu}[\p{L}\p{M}\p{N}_]+(?:[ -]\p{Lu}[\p{L}\p{M}\p{N}_]+){0,5}"
_WHEN = r"\(\p{L}+ \d+,? \d+ [\d:]+ ?(?:[AaPp][Mm])?\)"
_SLOTS = {"NAME": NAME, "WORD": r"\S+", "WORDS": r"\S+(?:\s\S+){0,5}", "REST": "[^.]*"}


def notice_pattern() -> str:
    """A name and what a group notice says of it, up to its full stop."""
    said = [r"\s+".join(_SLOTS.get(w, w) for w in n.split()) for n in V.GROUP_NOTICES]
    return f"{NAME}\\s+(?:{'|'.join(said)})\\.?"


def training_text(c) -> Column:
    """Without links, file marks, edit marks, reaction annotations and group notices, white space collapsed."""
    t = F.trim(F.regexp_replace(_c(c), r"(?i)https?://\S+", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)Download file:\s*\S+", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)\s*\(edited\)\s*$", ""))
    t = F.trim(F.regexp_replace(t, f"[{EMOJI_CLASS}{V.REACTION_MARKS}]+\\s*{NAME}(?:\\s*{_WHEN})?", " "))
    t = F.trim(F.regexp_replace(t, notice_pattern(), " "))
    return squash(t)


def without_emoji(c) -> Column:
    """P9."""
    return F.trim(F.regexp_replace(_c(c), f"[{EMOJI_CLASS}♥❤💕💗💖💘💝💞💟♡]", ""))


def french_chat(c) -> Column:
    """P10: spacing of French punctuation outside fenced code."""
    def one(s: Column) -> Column:
        s = F.regexp_replace(s, r"\s*,\s*", ", ")
        s = F.regexp_replace(s, r"\s*([!?;:]+)\s*", " $1 ")
        s = F.regexp_replace(s, r"\.{4,}", "...")
        s = F.regexp_replace(s, r"\s*(['’])\s*", "$1")
        return F.regexp_replace(s, "[ \t]+", " ")

    parts = F.split(_c(c), "```", -1)
    return F.trim(F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, one(s)).otherwise(s)), "```"))


def language_text(c) -> Column:
    """P11."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"https?://\S+", ""), r"\s{2,}", " "))


def device(c) -> Column:
    """The family of a platform string."""
    t = F.trim(_c(c))
    brand = F.regexp_extract(t, r"(?i)Android\s+OS.*\((\w+),", 1)
    rest = F.when(F.startswith(F.lower(t), F.lit("partner")), "Smart TV").otherwise(t)
    for p, name in reversed(V.DEVICES):
        rest = F.when(t.rlike(f"(?i){p}"), name).otherwise(rest)
    return F.when(t.isNull() | (t == ""), "Unknown").when(brand != "", F.concat(F.lit("Android ("), F.initcap(F.lower(brand)), F.lit(")"))).otherwise(rest)


def activity_name(c, names: dict[str, str] | None = None) -> Column:
    """A mapped name, else lower-cased with spaces."""
    t = _c(c)
    known = F.create_map(*[F.lit(x) for kv in (names or V.ACTIVITIES).items() for x in kv])
    return F.coalesce(known[t], F.lower(F.replace(t, F.lit("_"), F.lit(" "))))


def grid_cell(c, step: float = 0.01) -> Column:
    """The whole number of the cell, halves to even."""
    return F.bround(_c(c) / step).cast("long")


# Words that mark a part of an address as a region.
REGIONS = ["Metropolitan France", "Region", "Department", "Arrondissement", "Quartier", "Borough", "County", "State", "Province", "District", "Ile-de-France", "California", "New York", "England"]


def address(c) -> Column:
    """Struct of city and country of a comma-separated address."""
    p = F.transform(F.split(_c(c), ","), lambda x: F.trim(x))
    p = F.filter(p, lambda x: x != "")
    inner = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
    # one part with digits before the country is a postcode
    inner = F.when(F.element_at(inner, -1).rlike("[0-9]"), F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))).otherwise(inner)
    good = F.filter(inner, lambda x: ~reduce(lambda a, b: a | b, [F.contains(x, F.lit(r)) for r in REGIONS]))
    city = F.when(F.size(p) < 2, "Unknown City").otherwise(F.coalesce(F.try_element_at(good, F.lit(-1)), F.get(p, 0)))
    return F.struct(city.alias("city"), F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit("")).alias("country"))


def slug(c) -> Column:
    """P25."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z]", "")


def relation_label(c) -> Column:
    """A relation type as words, with its tense."""
    t = F.lower(F.replace(_c(c), F.lit("_"), F.lit(" ")))
    return F.concat(t, F.when(F.startswith(_c(c), F.lit("WAS_")), " (PAST)").when(F.startswith(_c(c), F.lit("IS_")), " (CURRENT)").otherwise(""))


def contains_any(c, keys: list[str]) -> Column:
    t = F.lower(_c(c))
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in keys])


def topics(c) -> Column:
    """All topics a text shows, in order."""
    return F.array_compact(F.array(*[F.when(contains_any(c, k), F.lit(t)) for t, k in V.INTERESTS.items()]))


def importance(c) -> Column:
    """The largest weight of the phrases found."""
    t = F.lower(_c(c))
    return F.greatest(F.lit(V.IMPORTANCE_BASE), *[F.when(F.contains(t, F.lit(k)), w).otherwise(V.IMPORTANCE_BASE) for k, w in V.IMPORTANCE.items()])


def emotion_word(c) -> Column:
    """The first emotion with a word in the text."""
    out = F.lit("neutral")
    for e, k in reversed(V.EMOTION_WORDS.items()):
        out = F.when(contains_any(c, k), e).otherwise(out)
    return out


def lives_here(c) -> Column:
    return contains_any(c, V.RESIDENCE["fr"] + V.RESIDENCE["en"])


def occurrences(c, key: str) -> Column:
    """Non-overlapping occurrences."""
    t = _c(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(key), F.lit("")))) / len(key)).cast("int")


def relation_scores(c) -> Column:
    t = F.lower(_c(c))
    # most texts hold none of a word, and looking for it costs far less than taking it out
    times = lambda k: F.when(F.contains(t, F.lit(k)), occurrences(t, k)).otherwise(0)
    return F.struct(*[reduce(lambda a, b: a + b, [times(k) for k in keys]).alias(name) for name, keys in V.RELATION_WORDS.items()])


def classify_relation(scores, n_messages) -> Column:
    """Struct of relation and confidence."""
    s, n = _c(scores), _c(n_messages)
    best = F.greatest(s["PARTNER"], s["FAMILY"], s["COLLEAGUE"])
    kind = F.when(s["PARTNER"] == best, "PARTNER_OF").when(s["FAMILY"] == best, "FAMILY_OF").otherwise("COLLEAGUE_OF")
    few = best < 2
    return F.struct(F.when(~few, kind).when(n > 50, "FRIEND_OF").otherwise("MET").alias("relation"),
                    F.when(~few, F.least(0.3 + 0.1 * best + n / 5000, F.lit(0.95))).when(n > 50, F.least(0.4 + n / 1000, F.lit(0.9))).otherwise(0.5).alias("confidence"))


def vad_reply(c) -> Column:
    """Valence, arousal and dominance of the first braces of a reply, clamped, with defaults."""
    j = F.from_json(F.regexp_extract(_c(c), r"\{[^{}]+\}", 0), "v double, a double, d double")
    clamp = lambda x, lo, d: F.least(F.greatest(F.coalesce(x, F.lit(d)), F.lit(lo)), F.lit(1.0))
    return F.struct(clamp(j["v"], -1.0, 0.0).alias("v"), clamp(j["a"], 0.0, 0.5).alias("a"), clamp(j["d"], 0.0, 0.5).alias("d"))


def is_noise(c) -> Column:
    """F4."""
    return _c(c).rlike("(?i)(?:" + ")|(?:".join(V.NOISE) + ")")


def is_emoji_reaction(c) -> Column:
    """F5."""
    return _c(c).rlike(r"(?U)^[^\w\s]{1,3}\s*[A-Z][\w\s-]+$")


def is_low_quality(c, least: int = 2, artefacts: list[str] | None = None) -> Column:
    """empty, emoji only, a stock phrase, an artefact, few words, or mostly emoji."""
    t = F.coalesce(_c(c), F.lit(""))
    bare = without_emoji(t)
    return (
        (t == "") | t.rlike(f"^[{EMOJI_CLASS}\\s♥❤💕💗💖💘💝💞💟♡]+$") | F.trim(t).rlike("(?i)^(?:" + "|".join(V.STOCK) + ")$")
        | t.rlike("(?i)(?:" + ")|(?:".join(artefacts or V.ARTEFACTS) + ")") | (word_count(bare) < least) | (F.length(bare) < 0.3 * F.length(t))
    )


def safe_double(c, default: float = 0.0) -> Column:
    """P40."""
    return F.coalesce(F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else F.try_to_number(c, F.lit("999999.999")).cast("double"), F.lit(default))


def safe_int(c: str, default: int = 0) -> Column:
    return F.coalesce(F.expr(f"cast(try_cast(`{c}` as double) as int)"), F.lit(default))


def think_split(c, tag: str = "think") -> Column:
    """Struct of the thought between tags and the answer after it."""
    t = _c(c)
    return F.struct(F.trim(F.regexp_extract(t, f"(?s)<{tag}>(.*?)</{tag}>", 1)).alias("thought"), F.trim(F.regexp_replace(t, f"(?s)<{tag}>.*?</{tag}>", "")).alias("answer"))


def token_estimate(context, history, system, predict: int) -> Column:
    """P22."""
    return ((F.length(_c(context)) + F.length(_c(history)) + F.length(_c(system)) + predict * 4) / 3).cast("int")


def shorten(c, n: int) -> Column:
    """Line feeds as spaces, at most n characters."""
    return F.substring(F.regexp_replace(_c(c), r"\s*\n\s*", " "), 1, n)
