"""Lookups and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import with_ordinal_id


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `no`, each row's place in a total order."""
    return with_ordinal_id(df, list(order), "").withColumn("no", F.col("id").cast("long")).drop("id")


def lookup(df: DataFrame, key, dim: DataFrame, dim_key: str, value: str, default, out: str) -> DataFrame:
    """A dimension's value, or a default. Whether the dimension is broadcast is decided by its size."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(value).alias("__v"))
    k = F.col(key) if isinstance(key, str) else key
    return df.join(d, k == F.col("__k"), "left").withColumn(out, F.coalesce("__v", default)).drop("__k", "__v")


def first_match(people: DataFrame, dim: DataFrame) -> DataFrame:
    """(q, pos, name) with (name, conversation): the conversation of the first person who has one."""
    j = people.join(dim, F.lower(people["name"]) == F.lower(dim["name"])).select("q", "pos", "conversation")
    return j.groupBy("q").agg(F.min_by("conversation", "pos").alias("conversation"))


def last_wins(dim: DataFrame, key: Column, value: str, seq: str, name: str) -> DataFrame:
    """An inverse mapping in which the last of equal keys stays."""
    return dim.groupBy(key.alias(name)).agg(F.max_by(value, seq).alias(value))


def coordinate_key(lat: str, lng: str) -> Column:
    return F.format_string("%.6f_%.6f", F.col(lat), F.col(lng))


def same_company(people: DataFrame, own: DataFrame, seq: str) -> DataFrame:
    """Connections at a company of one's own, in any case."""
    dim = last_wins(own, F.lower(F.trim("company")), "company", seq, "__c").withColumnRenamed("company", "own_company")
    return people.filter("trim(company) <> ''").join(dim, F.lower(F.trim("company")) == F.col("__c")).drop("__c")


def prefix_match(a: DataFrame, b: DataFrame, least: int = 5) -> DataFrame:
    """For each a.name the longest b.name that begins it or that it begins, of at least `least` characters (ties: first pos).

    Both directions are joins on equal strings: the prefixes of a.name with whole names of b, and a.name with the prefixes
    of b's names, of which each keeps the first only. So names that begin alike don't meet each other.
    Rows meet by numbers (lengths, and places in the order of pos, then name), so that groups are counted in hash tables
    and no names are sorted for them. Names packed in a small file are many in memory, so no task gets all of them.
    """
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(least), F.length(c)), lambda k: F.substring(c, 1, k)))
    x = a.filter(F.length("name") >= least).select("name").distinct()
    y = numbered(b.filter(F.length("name") >= least).groupBy(F.col("name").alias("match")).agg(F.min("pos").alias("pos")), "pos", "match")
    begins = x.select("name", prefixes(F.col("name")).alias("match")).join(y.select("match").hint("merge"), "match").groupBy("name").agg(F.max(F.length("match")).alias("k"))
    first = y.select(prefixes(F.col("match")).alias("name"), "no").groupBy("name").agg(F.min("no").alias("no"))
    begun = first.join(x.hint("merge"), "name").join(y.select("no", "match").hint("merge"), "no").select("name", "match")
    # a name that begins others of b, or stands there itself, can't share more with any of its own beginnings
    return begins.join(begun, "name", "full_outer").select("name", F.coalesce("match", F.expr("substring(name, 1, k)")).alias("match"))


def name_mention(questions: DataFrame, names: DataFrame) -> DataFrame:
    """For each question (q, text) the first known name it holds: whole, without spaces, or any part of three letters.

    Both sides are cut into their words and joined on them, then the phrase is checked.
    """
    qw = questions.select("q", F.lower("text").alias("t"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).filter("w <> ''")
    n = numbered(names.select("name", "pos").distinct(), "pos", "name")
    parts = F.split(F.lower("name"), " ")
    nw = n.select("name", "no", F.explode(F.array_distinct(F.concat(parts, F.array(F.replace(F.lower("name"), F.lit(" "), F.lit("")))))).alias("w")).filter("length(w) >= 3")
    j = qw.join(nw, "w")
    level = F.when(F.contains("t", F.lower("name")), 1).when((F.col("w") == F.replace(F.lower("name"), F.lit(" "), F.lit(""))), 2).otherwise(3)
    # the least number of each level, so that questions are counted in a hash table and no texts are sorted
    found = j.select("q", "no", level.alias("l")).groupBy("q").agg(*[F.min(F.when(F.col("l") == k, F.col("no"))).alias(f"n{k}") for k in (1, 2, 3)])
    return found.select("q", F.coalesce("n1", "n2", "n3").alias("no")).join(n.select("no", "name"), "no").select("q", "name")


def having(df: DataFrame, keys: DataFrame, on: str, present: bool = True) -> DataFrame:
    """J12, J13."""
    return df.join(keys.select(on).distinct(), on, "left_semi" if present else "left_anti")


def zip_rows(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """By explicit row id."""
    return a.join(b, id_)


def union_all(*frames: DataFrame) -> DataFrame:
    """U1."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def top_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """T6."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def right_wins(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U6."""
    return b.unionByName(a.join(b.select(key), key, "left_anti"))
