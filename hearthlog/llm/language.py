"""Language of pages by Bayesian fusion of evidence.

For each page: text likelihoods of a naive Bayes model over byte trigrams (trained here, on at most SAMPLE
distinct labelled texts of each language, chosen by hash), the declared markup language, the suffix of the host and a
language part of the path, and a host prior. Priors are smoothed hierarchically and come from grouped
aggregation: the language shares over all pages, those of the registered domain with the former as a prior of
fixed weight, those of the host with those of its domain. How reliable declarations and address parts are is
estimated from their agreement with the text, again by grouped aggregation.

Log posterior = host prior + text log likelihood (per trigram, tempered by EVIDENCE) + declaration + address.

Defined cases: html of any length is read whole; null or empty html leaves the text out (likelihood equal for all); a null url is a host of its
own; unknown declarations are no evidence; ties go to the language first in order; repeated rows give repeated
rows and count as often; without labelled rows or pages the result is empty; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, pieces, settle

SLOTS, SAMPLE = 1 << 15, 2000
#: Weight of a wider group in a narrower one, in pages; and the most trigrams that count as independent evidence.
PRIOR, EVIDENCE = 20.0, 30.0
_HIDDEN = re.compile(r"(script|style|noscript|template|title)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13] + list(range(33, 65)) + list(range(91, 97)) + list(range(123, 127))] = 32


def slots(buf: np.ndarray) -> np.ndarray:
    """The slot of the trigram at each byte; the last two wrap into the next text and are dropped by callers."""
    b = LOWER[buf].astype(np.uint32)
    x = b.copy()
    x[:-1] |= b[1:] << 8
    x[:-2] |= b[2:] << 16
    x *= np.uint32(0x9E3779B1)
    return x >> np.uint32(17)


def sample(labelled: DataFrame) -> DataFrame:
    """(lang, text): of each language the SAMPLE distinct texts first in order of hash, all where there are fewer."""
    x = labelled.filter("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    seen = settle(x.select("lang", "h").distinct(), "hashes")
    # a share of the distinct hashes first, so that about twice the sample is ranked
    part = seen.groupBy("lang").agg((F.lit(2.0 * SAMPLE) / F.count("*") * (1 << 30)).alias("most"))
    at = F.pmod("h", F.lit(1 << 30))
    w = Window.partitionBy("lang").orderBy(at, "h")
    least = seen.join(F.broadcast(part), "lang").filter(at <= F.col("most")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE).select("lang", "h")
    # copies of a text count once
    return x.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities (slot, language), from whole texts of a sample; all labelled languages."""
    arrow_limits(labelled.sparkSession)

    def run(batches):
        for b in batches:
            for p in pieces(b, "text"):
                names = p.column("lang").to_numpy(zero_copy_only=False)
                buf, off = buffers(p.column("text"))
                own = slots(buf) if len(buf) else np.zeros(0, np.uint32)
                for lang in set(names):
                    at = [own[a : z - 2] for a, z, n in zip(off[:-1], off[1:], names) if n == lang and z - a > 2]
                    slot, n = np.unique(np.concatenate(at), return_counts=True) if at else (np.zeros(0), np.zeros(0))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n, pa.int64())], names=["lang", "slot", "n"])

    langs = sorted(r[0] for r in labelled.filter("lang is not null").select("lang").distinct().collect())
    found = sample(labelled).mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows a language at most
    counts = np.full((SLOTS, max(1, len(langs))), 0.05)
    if found.num_rows:
        column = {lang: k for k, lang in enumerate(langs)}
        counts[found["slot"].to_numpy(), [column[lang] for lang in found["lang"].to_pylist()]] += found["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0))


# Second-level labels that country suffixes register names under.
SECOND = frozenset("ac co com edu gob gov go net ne nom or org sch".split())


def registered(host: str) -> str:
    """The registered domain of a host: two labels, or three under a country's second-level label."""
    labels = host.split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else labels[-2:])


def _registered(host) -> "F.Column":
    under = F.substring_index(host, ".", -2)
    return F.when(under.rlike("^(?:" + "|".join(sorted(SECOND)) + r")\.[a-z]{2}$"), F.substring_index(host, ".", -3)).otherwise(under)


def visible(html: str) -> str:
    """The text of a page: hidden elements, comments and tags become a space. What isn't closed is looked for once, so the
    work grows with the page however broken it is."""
    out, pos, missing = [], 0, set()

    def end(what: str, at: int) -> int:
        """Where the next `what` from `at` on ends, 0 if there is none."""
        if what in missing:
            return 0
        if what in _ENDS:
            m = _ENDS[what].search(html, at)
            found = m.end() if m else 0
        else:
            k = html.find(what, at)
            found = k + len(what) if k >= 0 else 0
        if not found:
            missing.add(what)
        return found

    while (at := html.find("<", pos)) >= 0:
        m = _HIDDEN.match(html, at + 1)
        close = (end(m[1].lower(), m.end()) if m else 0) or (end("-->", at + 4) if html.startswith("<!--", at) else 0) or end(">", at + 1)
        if not close:  # no tag is closed any more
            break
        out += [html[pos:at], " "]
        pos = close
    out.append(html[pos:])
    return _html.unescape("".join(out))


def likelihoods(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean log probability of each text's trigrams by language, times the evidence they count as."""
    buf, off = buffers(column)
    size = np.maximum(0, np.diff(off) - 2)
    out = np.zeros((len(size), table.shape[1]))
    if not len(buf) or not size.any():
        return out
    own = slots(buf)
    for k in range(table.shape[1]):
        total = np.concatenate([[0.0], np.cumsum(table[own, k], dtype=np.float64)])
        out[:, k] = (total[off[:-1] + size] - total[off[:-1]]) / np.maximum(1, size)
    return out * np.minimum(size, EVIDENCE)[:, None]


def scores(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, host, domain, declared, suffix, path_lang, text_scores) of each page."""
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(table.astype(np.float32))  # SLOTS rows, a column a language
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("text_scores", pa.list_(pa.float64()))])

    def run(batches):
        table = sent.value
        for b in batches:
            for p in pieces(b, "html"):
                pages = p.column("html").to_pylist()
                said = [m[1].lower() if h and (m := re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", h)) else None for h in pages]
                found = likelihoods(pa.array([visible(h) if h else "" for h in pages], pa.large_string()), table)
                yield pa.RecordBatch.from_arrays([p.column("page_id").cast(pa.int64()), p.column("url").cast(pa.string()), pa.array(said, pa.string()), pa.array(list(found), pa.list_(pa.float64()))], schema=schema)

    x = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, declared string, text_scores array<double>")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    known = F.array(*map(F.lit, langs))
    path = F.lower(F.regexp_extract("url", r"^[^/]*//[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return x.select("page_id", F.coalesce(host, F.lit("")).alias("host"), "declared", "text_scores", path.alias("path")).select(
        "page_id", "host", _registered(F.col("host")).alias("domain"), F.when(F.array_contains(known, F.col("declared")), F.col("declared")).alias("declared"), F.substring_index("host", ".", -1).alias("suffix"), F.when(F.array_contains(known, F.col("path")), F.col("path")).alias("path_lang"), "text_scores"
    )


def _shares(x: DataFrame, key: str, langs: list[str], wider, up: str | None) -> DataFrame:
    """(key, p: array of language shares) smoothed with the wider groups' shares (a table by `up`, or one array)."""
    counts = x.groupBy(key, *([up] if up else [])).agg(*[F.sum(F.get("text_p", i)).alias(f"n{i}") for i in range(len(langs))])
    counts = counts.join(wider.withColumnRenamed("p", "w"), up) if up else counts.withColumn("w", wider)
    counts = counts.select(key, "w", F.array(*[f"n{i}" for i in range(len(langs))]).alias("n")).withColumn("t", F.aggregate("n", F.lit(0.0), lambda s, v: s + v))
    return counts.select(key, F.zip_with("n", "w", lambda v, p: (v + PRIOR * p) / (F.col("t") + PRIOR)).alias("p"))


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, lang, confidence, text_lang, declared, path_lang, suffix of each page."""
    arrow_limits(pages.sparkSession)
    langs, table = train(labelled)
    n = len(langs)
    if not n:
        return pages.sparkSession.createDataFrame([], "page_id long, host string, lang string, confidence double, text_lang string, declared string, path_lang string, suffix string")
    x = scores(pages, langs, table)
    e = F.transform("text_scores", lambda v: F.exp(v - F.array_max("text_scores")))
    x = settle(x.withColumn("e", e).withColumn("text_p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda s, y: s + y))).drop("e"), "scores")
    total = x.agg(F.count("*"), *[F.sum(F.get("text_p", i)) for i in range(n)]).first()  # one number a language
    world = F.array(*[F.lit(((v or 0.0) + 1) / (total[0] + n)) for v in total[1:]])
    domains = _shares(x, "domain", langs, world, None)
    hosts = _shares(x, "host", langs, domains, "domain")

    def evidence(column: str) -> DataFrame:
        """(value, log likelihoods): how likely each language has this value, smoothed by all languages' share of it."""
        c = x.filter(F.col(column).isNotNull()).groupBy(column).agg(*[F.sum(F.get("text_p", i)).alias(f"n{i}") for i in range(n)])
        t = [v or 0.0 for v in c.agg(*[F.sum(f"n{i}") for i in range(n)]).first()]  # one number a language
        c = c.select(column, F.array(*[f"n{i}" for i in range(n)]).alias("n")).withColumn("share", F.aggregate("n", F.lit(0.0), lambda s, v: s + v) / F.lit(max(sum(t), 1e-9)))
        totals = F.array(*map(F.lit, t))
        return c.select(F.col(column).alias("__v"), F.zip_with("n", totals, lambda v, a: F.log((v + PRIOR * F.col("share") + 1e-6) / (a + PRIOR))).alias(f"{column}_l"))

    y = x.join(hosts.select("host", F.col("p").alias("host_p")), "host")
    for column in ("declared", "path_lang", "suffix"):
        y = y.join(evidence(column), F.col(column) == F.col("__v"), "left").drop("__v")
    none = F.array(*[F.lit(0.0)] * n)
    parts = F.arrays_zip("text_scores", "host_p", *[F.coalesce(f"{c}_l", none).alias(f"{c}_l") for c in ("declared", "path_lang", "suffix")])
    y = y.withColumn("post", F.transform(parts, lambda s: s["text_scores"] + F.log(s["host_p"]) + s["declared_l"] + s["path_lang_l"] + s["suffix_l"]))
    best = lambda c: F.get(F.array(*map(F.lit, langs)), (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    sure = 1 / F.aggregate("post", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("post")))
    return y.select("page_id", "host", best("post").alias("lang"), sure.alias("confidence"), F.when(F.array_max("text_scores") < 0, best("text_scores")).alias("text_lang"), "declared", "path_lang", "suffix")
