"""Personal data by weak supervision (native).

Patterns propose spans of several kinds. Eight labelers then vote on each span (yes, no, abstain): a strict
pattern, a gazetteer of known prefixes and endings, key words before the span, its surroundings, its variety of
characters, words of a language between separators (no), places that hold no secret (no: addresses, paths, dates,
round numbers), and how often letters and digits change. Expectation-maximisation over the counts of vote patterns (a
table whose size is bounded by kinds and labelers, not by rows) estimates how reliable each labeler is, and the
posteriors train a logistic span classifier on votes, kind and shape, again on counts; its weights begin at what the
estimated reliabilities say and are held near there, so a vote that the corpus hardly shows still counts. Base spans (email, ip, card, phone that
pass their checks) always stay; spans of other kinds stay when the classifier accepts them and no base span
overlaps.

Positions are code points, end exclusive. Matching marks each match between two control characters and
splits there; texts that hold this control character have it exchanged for another first, which no pattern
matches either, so positions stay.

The work on a text grows with its length and its matches, not with their square: starts are running sums, overlaps
are found in order of position.

Defined cases: null text is empty and has no spans; texts of any length are whole; rows are handled one by one, so repeated rows and
repeated ids give repeated rows; an empty table gives an empty table (and a classifier that rejects all);
other columns are kept, under their own names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, running, settle

# The patterns of the base kinds, made linear with possessive quantifiers, and of further kinds.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "contact": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *MORE]
GAZETTEER = {
    "email": r"\.(?i:com|org|net|edu|gov|info|de|fr|es|uk|eu|io)$",
    "ip": r"^(?!0|127\.|169\.254\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|3[47]|35|6011|65)",
    "phone": r"^\+(?:1|33|34|49|44|39|7|81|86|91)",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ)",
    "account": r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU)",
    "contact": r"^\(?(?:[2-9](?:0[1-9]|[1-8][0-9])|[89]00)",
}
#: Kinds whose gazetteer is complete (area codes), so that what is not in it is a no.
CLOSED = ("contact",)
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "card": r"^(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?[\x20.0-9-]+$",
    "secret": r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|AKIA[0-9A-Z]{16}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+]{20,})$",
    "account": r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){3,7}",
    "contact": r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([.-]))[0-9]{3}[.-][0-9]{4}$",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|address|from|to)\W{0,4}\w{0,6}\W{0,3}$",
    "ip": r"(?i)(?:\bip|host|server|address|login)\W{0,4}\w{0,6}\W{0,3}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment)\W{0,4}\w{0,8}\W{0,3}$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|whatsapp)\W{0,4}\w{0,8}\W{0,3}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|key|auth|credential)s?[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta)\W{0,4}\w{0,8}\W{0,3}$",
    "contact": r"(?i)(?:tel|phone|call|mobile|fax|whatsapp|contact)\W{0,4}\w{0,8}\W{0,3}$",
}
#: Surroundings and forms that no secret or number of a person has: body, and what stands before it.
ELSEWHERE = {
    "secret": r"^/.*/|^(?:19|20)[0-9]{2}[-/](?:0[1-9]|1[0-2])(?:[-/]|$)|^[a-z]{2,3}/",
    "contact": r"00\W+[0-9]00\W+[0-9]{2}00$",
}
ADDRESS = r"(?i)(?:://|www\.)[^\s=]*$|[A-Za-z]:\\\S*$"
#: Words of a language between separators: letters of one case, or a capital first, with a vowel.
WORD = r"(?<![A-Za-z])(?=[A-Za-z]*[aeiouyAEIOUY])(?:[A-Z]?[a-z]{3,}|[A-Z]{4,})(?![A-Za-z])"
LABELERS = ("strict", "gazetteer", "context", "edges", "variety", "words", "place", "mixing")
MARK, STAND_IN, AROUND = "\x01", "\x02", 24
ROUNDS, ACCEPT = 30, 0.5
#: Virtual votes that a labeler begins with, right and wrong ones, and how strongly weights are held near their start.
RIGHT, WRONG, HOLD = 8, 2, 0.02
SPAN = "array<struct<start:int,kind:string,end:int,body:string,before:string,after:string>>"


def _parts(body: Column, pattern: str, guard: Column) -> Column:
    """body cut at the borders of the pattern's matches, leftmost, non-overlapping: every second part is a match."""
    return F.when(guard, F.split(F.regexp_replace(body, pattern, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(F.array(F.lit("")))


def _matches(parts: Column, starts: Column, kind: str) -> Column:
    """The matches among the parts, with their surroundings."""
    def span(i: Column) -> Column:
        body, at = F.get(parts, i), F.get(starts, i)
        return F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(body)).alias("end"), body.alias("body"), F.right(F.get(parts, i - 1), F.lit(AROUND)).alias("before"), F.substring(F.get(parts, i + 1), 1, 1).alias("after"))

    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), span)).otherwise(F.array().cast(SPAN))


def _apart(x: DataFrame, spans: str, others: str) -> DataFrame:
    """x with its column `spans` reduced to the spans that overlap none of the column `others`.

    Both are merged in order of start; the greatest end of the others before a span and the least start of those
    after it tell.
    """
    slim = lambda c, own: F.transform(c, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), i.alias("i")))
    needed = (F.size(spans) > 0) & (F.size(others) > 0)
    far, end = (1 << 31) - 1, F.lit(0)
    x = x.withColumn("__all", F.when(needed, F.array_sort(F.concat(slim(spans, True), slim(others, False)))))
    x = x.withColumn("__ends", F.transform("__all", lambda s: F.when(s["own"], 0).otherwise(s["end"]))).withColumn("__starts", F.reverse(F.transform("__all", lambda s: F.when(s["own"], far).otherwise(s["start"]))))
    x = x.withColumn("__before", F.when(needed, running(F.col("__ends"), end, lambda a, b: F.greatest(a, b)))).withColumn("__after", F.when(needed, F.reverse(running(F.col("__starts"), F.lit(far), lambda a, b: F.least(a, b)))))
    free = F.filter("__all", lambda s, i: s["own"] & (F.get("__before", i) <= s["start"]) & (F.get("__after", i) >= s["end"]))
    # both are named twice, so the optimizer does not put them into the filter's function, to be made for each span
    left = F.when(needed & (F.size("__before") == F.size("__after")), F.transform(free, lambda s: F.get(F.col(spans), s["i"]))).otherwise(F.col(spans))
    return x.withColumn(spans, left).drop("__all", "__ends", "__starts", "__before", "__after")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Whether the digits pass the check: from the right, every second digit doubled, sums a multiple of ten."""
    d = F.split(F.reverse(_digits(c)), "")
    total = F.aggregate(F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2).cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def _passes(s: Column) -> Column:
    parts = F.transform(F.split(s["body"], r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    n = F.length(_digits(s["body"]))
    return F.when(s["kind"] == "ip", small).when(s["kind"] == "card", (n >= 14) & (n <= 19) & _luhn(s["body"])).when(s["kind"] == "phone", (n >= 10) & (n <= 15)).otherwise(True)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base (base spans, checked) and __more (other proposals that overlap no base span)."""
    x = docs.withColumn("__t", F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), MARK, STAND_IN))
    t, digit = F.col("__t"), F.col("__d")
    x = x.withColumn("__d", t.rlike("[0-9]"))
    guards = {"email": F.contains(t, F.lit("@")), "ip": digit & t.rlike(r"\.[0-9]++\.[0-9]"), "card": digit & t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": digit & F.contains(t, F.lit("+")), "secret": digit, "account": digit & t.rlike("[A-Z]{2}[0-9]{2}"), "contact": digit & t.rlike("[0-9]{3}[\\x20.-][0-9]{4}")}
    patterns = BASE | MORE
    x = x.withColumns({f"__p_{k}": _parts(t, p, guards[k]) for k, p in patterns.items()})
    x = x.withColumns({f"__n_{k}": F.transform(f"__p_{k}", lambda p: F.length(p)) for k in patterns})
    x = x.withColumns({f"__s_{k}": F.when(F.size(f"__p_{k}") > 1, running(F.col(f"__n_{k}"), F.lit(0), lambda a, n: a + n)) for k in patterns})
    found = {k: _matches(F.col(f"__p_{k}"), F.col(f"__s_{k}"), k) for k in patterns}
    x = x.withColumns({f"__{k}": F.filter(m, _passes) if k in BASE else m for k, m in found.items()}).drop(*[f"__{c}_{k}" for c in "pns" for k in patterns], "__t", "__d")
    x = x.withColumn("__base", F.concat(*[f"__{k}" for k in BASE]))
    # earlier kinds win where further kinds overlap each other
    for k in MORE:
        x = _apart(x, f"__{k}", "__base")
    x = x.withColumn("__more", F.array().cast(SPAN)).withColumn("__seen", F.array().cast(SPAN))
    for k in MORE:
        x = _apart(x.withColumn("__own", F.col(f"__{k}")), "__own", "__seen")
        x = x.withColumn("__more", F.concat("__more", "__own")).withColumn("__seen", F.concat("__seen", f"__{k}"))
    return x.drop("__own", "__seen", *[f"__{k}" for k in patterns])


def votes(s: Column) -> Column:
    """Votes of the labelers on a span: 1 yes, 0 no, -1 abstains; with two features of its shape."""
    def by_kind(table: dict, value: Column, no: int) -> Column:
        out = F.lit(-1)
        for k, p in table.items():
            out = F.when(s["kind"] == k, F.when(value.rlike(p), 1).otherwise(no)).otherwise(out)
        return out

    inner = r"[A-Za-z0-9]$"
    secret, size = s["kind"] == "secret", F.length(s["body"])
    wordy = (size - F.length(F.regexp_replace(s["body"], WORD, ""))) / size
    plain = F.regexp_replace(s["body"], "[^A-Za-z0-9]", "")
    distinct = F.size(F.array_distinct(F.split(plain, "")))
    turns = (F.length(F.regexp_replace(plain, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", "|")) - F.length(plain)) / F.greatest(F.length(plain) - 1, F.lit(1))
    return F.struct(
        by_kind(STRICT, s["body"], 0).alias("strict"), F.greatest(by_kind(GAZETTEER, s["body"], -1), F.when(s["kind"].isin(*CLOSED), 0).otherwise(-1)).alias("gazetteer"), by_kind(CONTEXT, s["before"], -1).alias("context"),
        F.when(s["before"].rlike(inner) | s["after"].rlike(inner), 0).otherwise(1).alias("edges"),
        F.when(distinct >= 8, 1).when(distinct <= 4, 0).otherwise(-1).alias("variety"),
        F.when(secret & (wordy >= 0.4), 0).otherwise(-1).alias("words"),
        F.when((secret & s["before"].rlike(ADDRESS)) | (by_kind(ELSEWHERE, s["body"], -1) == 1), 0).otherwise(-1).alias("place"),
        F.when(secret & (turns >= 0.25), 1).when(secret & (turns <= 0.2), 0).otherwise(-1).alias("mixing"),
        F.least(F.lit(3), (F.length(s["body"]) / 8).cast("int")).alias("size"), F.least(F.lit(3), (4 * F.length(_digits(s["body"])) / F.length(s["body"])).cast("int")).alias("digits"),
    )


def estimate(table: list[tuple]) -> tuple[dict, dict, dict]:
    """EM over (kind, votes..., count): per kind a prior, per labeler the chance of a yes where true and where false.

    Labelers begin better than chance, with RIGHT and WRONG virtual votes, which fixes the meaning of "true"; what the
    data say may take them anywhere from there. Returns the posterior of each vote pattern, the reliabilities and the
    priors.
    """
    prior = {k: 0.5 for k in KINDS}
    sure = RIGHT / (RIGHT + WRONG)
    rel = {(j, c): (sure if c else 1 - sure) for j in range(len(LABELERS)) for c in (0, 1)}
    post: dict = {}
    for _ in range(ROUNDS):
        for kind, *v, _n in table:
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, x in enumerate(v):
                if x >= 0:
                    a += math.log(rel[j, 1] if x else 1 - rel[j, 1])
                    b += math.log(rel[j, 0] if x else 1 - rel[j, 0])
            post[kind, *v] = 1 / (1 + math.exp(max(-50, min(50, b - a))))
        for k in prior:
            rows = [(post[r[:-1]], r[-1]) for r in table if r[0] == k]
            prior[k] = (2 + sum(p * n for p, n in rows)) / (4 + sum(n for _, n in rows))
        for j in range(len(LABELERS)):
            for c in (0, 1):
                w = [((post[r[:-1]] if c else 1 - post[r[:-1]]) * r[-1], r[1 + j]) for r in table if r[1 + j] >= 0]
                yes, all_ = sum(x for x, v in w if v), sum(x for x, _ in w)
                rel[j, c] = min(0.99, max(0.01, (yes + (RIGHT if c else WRONG)) / (all_ + RIGHT + WRONG)))
    return post, rel, prior


def _features(kind: str, v: tuple, size: int, digits: int) -> list[str]:
    return [f"kind:{kind}", *[f"{name}:{x}" for name, x in zip(LABELERS, v) if x >= 0], f"size:{size}", f"digits:{digits}"]


def train(rows: list[tuple], post: dict, rel: dict, prior: dict) -> dict:
    """Logistic regression on (kind, votes..., size, digits, count) with the posteriors as soft labels.

    Weights begin at the log odds that reliabilities and priors give (shapes at 0) and are drawn back to them.
    """
    n = len(LABELERS)
    start = {f"kind:{k}": math.log(p / (1 - p)) for k, p in prior.items()} | {"": 0.0}
    for j, name in enumerate(LABELERS):
        start[f"{name}:1"], start[f"{name}:0"] = math.log(rel[j, 1] / rel[j, 0]), math.log((1 - rel[j, 1]) / (1 - rel[j, 0]))
    data = [(_features(r[0], r[1 : n + 1], r[n + 1], r[n + 2]), post[r[: n + 1]], r[n + 3]) for r in rows]
    start |= {f: 0.0 for fs, _, _ in data for f in fs if f not in start}
    weight = dict(start)
    total = sum(math.sqrt(c) for _, _, c in data) or 1
    for _ in range(300):
        grad = {f: HOLD * (w - start[f]) for f, w in weight.items()}
        for fs, y, c in data:
            p = 1 / (1 + math.exp(-max(-40, min(40, weight[""] + sum(weight[f] for f in fs)))))
            d = math.sqrt(c) * (p - y) / total
            for f in (*fs, ""):
                grad[f] += d
        for f, g in grad.items():
            weight[f] -= g
    return weight


def learn(found: DataFrame) -> dict:
    """The classifier's weights, from all spans proposed in `found`."""
    v = found.select(F.explode(F.concat("__base", "__more")).alias("s")).select(F.col("s.kind").alias("kind"), votes(F.col("s")).alias("v")).groupBy("kind", "v").count()
    rows = sorted(tuple([r["kind"], *r["v"], r["count"]]) for r in v.collect())  # at most kinds x votes x shapes rows
    table: dict = {}
    for r in rows:
        table[r[:-3]] = table.get(r[:-3], 0) + r[-1]
    return train(rows, *estimate([(*k, n) for k, n in table.items()]))


def _score(s: Column, weight: dict) -> Column:
    v = votes(s)
    total = F.lit(weight.get("", 0.0))
    for f, w in weight.items():
        name, _, x = f.partition(":")
        if name == "kind":
            total = total + F.when(s["kind"] == x, w).otherwise(0.0)
        elif name:
            total = total + F.when(v[name] == int(x), w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def decide(found: DataFrame, weight: dict) -> DataFrame:
    """found with spans: the base spans and the accepted others, by start and kind."""
    scored = F.transform("__more", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _score(s, weight).alias("p")))
    x = found.withColumn("__p", scored)
    slim = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))
    return x.withColumn("base_spans", F.array_sort(F.transform("__base", slim))).withColumn("spans", F.array_sort(F.concat(F.transform("__base", slim), F.transform(F.filter("__p", lambda s: s["p"] > ACCEPT), slim)))).drop("__p", "__base", "__more")


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and spans (arrays of start, order, kind, end)."""
    found = settle(candidates(docs, text), "found")
    return decide(found, learn(found))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, proposed, accepted): how many further spans of each kind are proposed and stay."""
    found = settle(candidates(docs.select(text), text).drop(text), "found")
    weight = learn(found)
    s = found.select(F.explode("__more").alias("s"))
    return s.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("proposed"), F.count_if(_score(F.col("s"), weight) > ACCEPT).alias("accepted"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans, digest of them, all spans."""
    found = settle(candidates(docs.select("doc_id", "text")).drop("text"), "spans")
    done = decide(found, learn(found))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", *[count(k) for k in BASE], F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one."""
    named = {c: f"__o{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]).alias("__row"), F.col(f"`{text}`").cast("string").alias("__body"))
    # written once: learning and deciding must not both search the texts
    found = settle(candidates(rows, "__body").drop("__body"), "found")
    x = decide(found, learn(found)).withColumn("__body", F.col(f"__row.{named[text]}").cast("string"))
    some = F.size("spans") > 0
    x = x.withColumn("__c", F.when(some, chunks(F.col("__body")))).withColumn("__e", F.when(some, F.transform("spans", lambda s: s["end"])))
    x = x.withColumn("__before", F.when(some, running(F.col("__e"), F.lit(0), lambda a, b: F.greatest(a, b))))
    piece = lambda s, i: F.when(s["start"] < F.get("__before", i), F.lit("")).otherwise(F.concat(cut(F.col("__c"), F.get("__before", i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    new = F.concat(F.array_join(F.transform("spans", piece), ""), cut(F.col("__c"), F.array_max("__e"), F.length("__body")))
    new = F.when(some, new).otherwise(F.col("__body"))
    return x.select(*[(new if c == text else F.col(f"__row.{n}")).alias(c) for c, n in named.items()])
