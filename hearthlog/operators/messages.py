"""Message tables: own messages, export filters, conversation names, visits, replies from a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import aggregates, joins, search


def ordered(df: DataFrame) -> DataFrame:
    """T1."""
    return df.orderBy("date", "ord")


def newest(df: DataFrame, n: int, condition: Column | None = None) -> DataFrame:
    """The n newest rows."""
    x = df if condition is None else df.filter(condition)
    return x.orderBy(F.desc("date"), F.desc("ord")).limit(n)


def self_name(df: DataFrame) -> str | None:
    row = aggregates.most_frequent(df, "sender_name", "ord").first()
    return row["sender_name"] if row else None


def own_messages(df: DataFrame, own: str, least: int = 3, languages_out: list[str] = ()) -> DataFrame:
    """What one person wrote, cleaned: enough words before and after, no noise, no bare reactions."""
    x = df.filter((F.col("sender_name") == own) & (T.word_count("text") >= least))
    if languages_out:
        x = x.filter(~F.col("language").isin(*languages_out))
    x = x.withColumn("text", T.persona_text("text"))
    return x.filter((T.word_count("text") >= least) & ~T.is_noise("text") & ~T.is_emoji_reaction("text"))


def export_filter(df: DataFrame, as_of, years: int = 5, language: str = "en") -> DataFrame:
    """F8: recent texts of a language that are of use after cleaning."""
    x = df.filter((F.col("date") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {365 * years} days")) & (F.col("language") == language) & (F.col("type") == "text"))
    x = x.withColumn("text", T.training_text("text"))
    return x.filter(~T.is_low_quality("text"))


def export_reason(as_of, years: int = 5, language: str = "en") -> Column:
    """Why a row is left out of the export, or `kept`."""
    old = F.col("date") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {365 * years} days")
    return F.when(old, "old").when(F.col("language") != language, "language").when(F.col("type") != "text", "type").when(T.is_low_quality(T.training_text("text")), "quality").otherwise("kept")


def without_reactions(df: DataFrame) -> DataFrame:
    """system rows stay."""
    return df.filter(F.coalesce("type", F.lit("text")) != "reaction")


def spoken(df: DataFrame, own: str) -> DataFrame:
    """Conversations where the owner spoke, without the one with themselves."""
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    x = df.filter(plain(F.col("conversation")) != plain(F.lit(own)))
    return joins.having(x, x.filter(F.col("sender_name") == own), "conversation")


def with_own_messages(df: DataFrame, own: str, least: int = 2) -> DataFrame:
    """F17."""
    return own_messages(df, own).groupBy("conversation").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy("conversation")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """A11, A30, A31."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def person_stats(df: DataFrame, name: str, polarity: Column) -> DataFrame:
    """Messages and mean polarity of the first person whose name holds `name`."""
    x = df.filter(F.contains(F.lower("sender_name"), F.lit(name.lower())))
    return x.groupBy("sender_name").agg(F.count("*").alias("n"), F.avg(polarity).alias("polarity")).orderBy("sender_name").limit(1)


def visit_ids(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """Ids from the start, the place and the position among all stays of a key, before any filter; equal ones by `ties`."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("start_time", "name", *ties)) - 1
    return df.withColumn("id", F.concat(F.lit("visit_"), F.regexp_replace(F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"), " ", "_"), F.lit("_"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"), F.lit("_"), F.format_string("%03d", i)))


def trip_ids(df: DataFrame, key: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy(key).orderBy("start_time", "mode")) - 1
    mode = F.lower(F.replace(F.coalesce("mode", F.lit("unknown")), F.lit("IN_"), F.lit("")))
    return df.withColumn("id", F.concat(F.lit("trip_"), F.date_format("start_time", "yyyy-MM-dd"), F.lit("_"), mode, F.lit("_"), F.format_string("%03d", i)))


def display_names(ids: DataFrame, friends: DataFrame) -> DataFrame:
    """(conversation) to (conversation, name): a friend with the same letters, else the longest that begins
    alike, else the id in title case."""
    bare = F.regexp_replace("conversation", r"_?[0-9]+$", "")
    x = ids.select("conversation", T.slug(bare).alias("name"), bare.alias("bare"))
    f = joins.numbered(friends.select(F.col("name").alias("friend"), T.slug("name").alias("slug"), "pos"), "pos", "friend")
    # the least number of a slug, then its name: no names are sorted
    exact = f.groupBy("slug").agg(F.min("no").alias("no")).join(f.select("no", F.col("friend").alias("exact")), "no").drop("no")
    near = joins.prefix_match(x.select("name").distinct(), f.select(F.col("slug").alias("name"), "pos")).withColumnRenamed("match", "slug2")
    out = x.join(exact, x["name"] == exact["slug"], "left").drop("slug").join(near, "name", "left")
    two = exact.select(F.col("slug").alias("slug2"), F.col("exact").alias("near"))
    return out.join(two, "slug2", "left").select("conversation", F.coalesce("exact", "near", F.initcap(F.regexp_replace("bare", "[_.]+", " "))).alias("name"))


def history_answer(corpus: DataFrame, question: str, vector: list[float], conversation: str | None = None, about: str | None = None, newest_n: int = 100, global_n: int = 50) -> DataFrame:
    """V7: a conversation's newest rows where it is named, the nearest of all where a name is asked about, else nearest."""
    if conversation:
        return newest(corpus, newest_n, F.col("conversation") == conversation)
    x = corpus if about is None else corpus.filter(F.contains(F.lower("content"), F.lit(about.lower())))
    return search.knn(x, vector, global_n, "id")


def history_context(corpus: DataFrame, episodes: DataFrame, names: DataFrame, question: str, vector: list[float], conversation: str | None = None, about: str | None = None, n_episodes: int = 5, **limits) -> DataFrame:
    """V7: (kind, pos, line): the nearest episodes with their feeling, then the answer's messages with chat and sender.

    corpus: id, content, embedding, date, ord, conversation, sender_name; episodes: id, content, embedding, date, emotion;
    names: conversation, name.
    """
    felt = F.when((F.coalesce("emotion", F.lit("")) != "") & (F.col("emotion") != "neutral"), F.concat(F.lit(" (Emotion: "), "emotion", F.lit(")"))).otherwise("")
    line = lambda *x: F.concat(F.lit("["), F.coalesce(F.col("date").cast("string"), F.lit("Unknown")), F.lit("] "), *x)
    e = search.ranked(episodes.withColumn("distance", search.distance("embedding", vector)), "distance", "id", n=n_episodes)
    said = history_answer(corpus, question, vector, conversation, about, **limits)
    order = [F.desc("date"), F.desc("ord")] if conversation else [F.col("distance"), F.col("id")]
    said = said.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # the few rows of the answer
    said = said.join(names.select("conversation", F.col("name").alias("__chat")), "conversation", "left")
    lines = line(F.lit("[Chat: "), F.coalesce("__chat", F.lit("Unknown Chat")), F.lit("] "), F.coalesce("sender_name", F.lit("Unknown Sender")), F.lit(": "), "content")
    return e.select(F.lit("episode").alias("kind"), "pos", line("content", felt).alias("line")).unionByName(said.select(F.lit("message").alias("kind"), "pos", lines.alias("line")))


def keep_relevant(df: DataFrame, verdict: Column) -> DataFrame:
    """what is judged relevant, and what could not be judged."""
    return df.filter(F.coalesce(verdict, F.lit(True)))
