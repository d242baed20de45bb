"""Quality rules by adaptive thresholds from quantile sketches (native).

Per text: word and symbol counts, repeated lines and repeated three-word windows. Fixed base rules reject
very short and mostly repeated texts. All other verdicts come from the data: for each language and source a
mergeable quantile sketch (counts per bucket of a logarithmic grid, so that sketches add up bucket by bucket and a
quantile is within 2 % of its value) gives the quartiles of each ratio; a text is rejected when a ratio lies beyond
the far fence, which is the upper quartile times the spread of the quartiles (their quotient, at least SPREAD) to
the power FENCE; for the length of words also when it lies below the mirrored lower fence. Counts have half an event
added, so a short text without any says less than a long one, and quartiles are never zero.

Groups with few texts borrow from their language and from all texts: the counts of the wider group enter with a
fixed weight. A group's fence is at most BOUND times that of its language and of all texts, in both of which each
group counts alike however large it is, so that a large source with much junk doesn't raise its own; word length,
which follows the script, is bounded by the language alone. Junk in a quarter of the average source isn't seen.

Defined cases: null text is an empty text (n_words 0, base_failed); texts of any length are whole, one row's
words and windows are arrays of that row alone; null language or source is a group of its own; repeated rows are
judged one by one and get equal verdicts; an empty table gives an empty table; other columns are carried along
under their names (those of this operator are taken from it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, settle

SYMBOLS = "#*$%&|<>"
METRICS = ("symbol_rate", "repeat_rate", "line_rate", "word_length")
#: Least quotient of a group's quartiles that its fences are drawn from; a group of very even texts would else reject its own tail.
SPREAD = {"symbol_rate": 6.0, "repeat_rate": 6.0, "line_rate": 6.0, "word_length": 1.15}
FENCE, PRIOR, GRID = 2.0, 50.0, 1.04
#: Most that a group's fence can be, in fences of its language and of all texts.
BOUND = 2.0
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts and base_failed."""
    keep = [c for c in docs.columns if c not in OWN]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    flat = F.translate(body, SPACES, " " * len(SPACES))
    x = docs.select(*[F.col(f"`{c}`") for c in keep], F.array_remove(F.split(flat, " "), "").alias("__w"), F.length(F.translate(body, SYMBOLS, "")).alias("__rest"), F.length(body).alias("__all"),
                    F.filter(F.split(body, "\n"), lambda a: F.length(F.translate(a, SPACES, "")) > 0).alias("__lines"))
    n = F.size("__w")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    x = x.withColumns({"__h": windows, "n_words": n.cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"), "n_symbols": (F.col("__all") - F.col("__rest")).cast("long"),
                       "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__w", "__lines", "__rest", "__all")
    # positions of equal windows stand next to each other after sorting; where all differ nothing is sorted
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    ranked = F.array_sort(F.transform("__h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    x = x.withColumn("__s", F.when(some, ranked)).drop("__h")
    twice = F.filter(F.col("__s"), lambda a, k: (F.get("__s", k - 1)["v"] == a["v"]) | (F.get("__s", k + 1)["v"] == a["v"]))
    x = x.withColumn("__i", F.array_sort(F.transform(twice, lambda a: a["i"]))).drop("__s")
    gaps = F.transform("__i", lambda a, k: F.when(k == F.size("__i") - 1, 3).otherwise(F.least(F.lit(3), F.get("__i", k + 1) - a)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, g: s + g)
    x = x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__i")
    return x.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).select(*keep, *OWN)


def ratios() -> dict:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbol_rate": (F.col("n_symbols") + 0.5) / n, "repeat_rate": (F.col("n_repeat_words") + 0.5) / n, "line_rate": (F.col("n_dup_lines") + 0.5) / n, "word_length": F.col("word_chars") / n}


def _bucket(v):
    return F.floor(F.log(v) / F.log(F.lit(GRID))).cast("int")


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key, metric and grid bucket; sketches merge by adding counts. Texts that failed the base rules don't set thresholds."""
    r = ratios()
    return (
        measured.filter(~F.col("base_failed"))
        .select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(r[m]).alias("bucket")) for m in METRICS])).alias("e"))
        .groupBy(*keys, "e.metric", "e.bucket").agg(F.count("*").alias("n"))
    )


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source and the fences (least_ and most_) of each metric, from a sketch by lang and source.

    A group's distribution is its own plus PRIOR texts spread as its language's, which in turn has PRIOR
    texts spread as all. The number of rows is that of the groups times the grid's buckets.
    """
    def share(x: DataFrame, keys: list[str]) -> DataFrame:
        total = x.groupBy(*keys, "metric").agg(F.sum("n").alias("__t"))
        return x.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n")).join(total.withColumnsRenamed({k: f"__{k}" for k in [*keys, "metric"]}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "metric"]]).select(*keys, "metric", "bucket", "n", (F.col("n") / F.col("__t")).alias("p"))

    groups = counts.select("lang", "source").distinct()
    langs = counts.select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    world = share(counts, []).select("metric", "bucket", (F.col("p") * PRIOR).alias("w"))
    by_lang = counts.groupBy("lang", "metric", "bucket").agg(F.sum("n").cast("double").alias("w")).unionByName(langs.join(world, "metric").select("lang", "metric", "bucket", "w")).groupBy("lang", "metric", "bucket").agg(F.sum("w").alias("n"))
    prior = share(by_lang, ["lang"]).select(F.col("lang").alias("__l"), "metric", "bucket", (F.col("p") * PRIOR).alias("w"))
    mixed = (
        counts.select("lang", "source", "metric", "bucket", F.col("n").cast("double").alias("w"))
        .unionByName(groups.join(prior, F.col("lang").eqNullSafe(F.col("__l"))).select("lang", "source", "metric", "bucket", "w"))
    )

    def quantile(q: float):
        found = F.aggregate("s", F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("b")), lambda a, e: F.struct((a["c"] + e["w"]).alias("c"), F.when(a["b"].isNull() & (a["c"] + e["w"] >= F.col("t") * q - 1e-9), e["bucket"]).otherwise(a["b"]).alias("b")))["b"]
        return F.pow(F.lit(GRID), found + 0.5)

    spread = F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv])

    def fence(x: DataFrame, keys: list[str], name: str) -> DataFrame:
        x = x.groupBy(*keys, "metric", "bucket").agg(F.sum("w").alias("w"))
        x = x.groupBy(*keys, "metric").agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("s"), F.sum("w").alias("t"))
        x = x.select(*keys, "metric", quantile(0.25).alias("lo"), quantile(0.75).alias("hi"))
        wide = F.pow(F.greatest(F.col("hi") / F.col("lo"), spread[F.col("metric")]), F.lit(FENCE))
        return x.select(*keys, "metric", (F.col("hi") * wide).alias(name), (F.col("lo") / wide).alias(f"{name}_low"))

    # each group with the same weight, small ones with their number of texts
    even = counts.groupBy("lang", "source", "metric").agg(F.collect_list(F.struct("bucket", "n")).alias("s"), F.sum("n").alias("t")).select("lang", "metric", "t", F.explode("s").alias("e"))
    even = even.select("lang", "metric", "e.bucket", (F.col("e.n") / F.col("t") * F.least(F.col("t"), F.lit(PRIOR))).alias("w"))
    wide = fence(even, ["lang"], "of_lang").join(fence(even, [], "of_all"), "metric")  # METRICS rows a language
    wide = wide.select(F.col("lang").alias("__l"), F.col("metric").alias("__m"), (BOUND * F.when(F.col("metric") == "word_length", F.col("of_lang")).otherwise(F.least("of_lang", "of_all"))).alias("most"))
    cut = fence(mixed, ["lang", "source"], "own").join(wide, F.col("lang").eqNullSafe(F.col("__l")) & (F.col("metric") == F.col("__m")))
    one = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return cut.groupBy("lang", "source").agg(*[one(m, F.least("own", "most")).alias(f"most_{m}") for m in METRICS], one("word_length", F.col("own_low")).alias("least_word_length"))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured with kept; a group without a threshold keeps what passed the base rules."""
    c = cuts.toDF(*[f"__{x}" for x in cuts.columns])
    r = ratios()
    bad = r["word_length"] < F.col("__least_word_length")
    for m in METRICS:
        bad = bad | (r[m] > F.col(f"__most_{m}"))
    bad = F.coalesce(bad, F.lit(False))
    j = measured.join(c, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    return j.withColumn("kept", ~F.col("base_failed") & ~bad).drop(*c.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its columns but the text, the counts, base_failed and kept."""
    m = settle(measure(docs).drop("text"), "measured")
    return judge(m, settle(thresholds(sketch(m, ["lang", "source"])), "cuts"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs."""
    named = [f"__o{i}" for i, _ in enumerate(docs.columns)]
    work = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, named)]).alias("__row"), "lang", "source", "text")
    # written once: judging must not repeat the measuring expressions inside its filters
    m = settle(measure(work).drop("text"), "measured")
    cuts = settle(thresholds(sketch(m, ["lang", "source"])), "cuts")
    return judge(m, cuts).filter("kept").select(*[F.col(f"__row.{n}").alias(c) for c, n in zip(docs.columns, named)])
