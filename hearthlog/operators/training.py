"""Chat training examples: roles, blocks, exchanges, preparation, inspection.

Messages of examples: messages array<struct<role, content>>; flat form: (conv_id, turn, role, text).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.text import word_count
from ..sources.store import stage

MESSAGES = "array<struct<role:string,content:string>>"


def flatten_content(blocks: str) -> Column:
    """The texts of content blocks, joined by spaces."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), " ")


def merge_roles(messages) -> Column:
    """Neighbouring messages of one role as one."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.aggregate(m, F.array().cast(MESSAGES), lambda out, x: F.when(
        (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["role"] == x["role"]),
        F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(x["role"].alias("role"), F.concat(F.try_element_at(out, F.lit(-1))["content"], F.lit(" "), x["content"]).alias("content")))),
    ).otherwise(F.concat(out, F.array(F.struct(x["role"].alias("role"), x["content"].alias("content"))))))


def merge_role_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """P31 on rows: runs of one role."""
    w = Window.partitionBy(conv).orderBy(turn)
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1))
    x = df.withColumn("block", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(conv, "block", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "text"))), lambda s: s["text"]), " ").alias("text"))


def role_sequence(messages: str) -> Column:
    """P32."""
    return F.array_join(F.transform(messages, lambda m: m["role"]), "→")


def history(messages: str) -> Column:
    """User and assistant messages with content."""
    return F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.coalesce(m["content"], F.lit("")) != "")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def examples(df: DataFrame) -> DataFrame:
    """Messages of each conversation in the order of its turns."""
    return df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))).alias("messages"))


def turn_blocks(df: DataFrame, conv: str, ts: str, order: str, is_self: str, text: str) -> DataFrame:
    """Runs of messages of one side."""
    w = Window.partitionBy(conv).orderBy(ts, order)
    new = F.coalesce((F.col(is_self) != F.lag(is_self).over(w)).cast("int"), F.lit(1))
    x = df.withColumn("block", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(conv, "block", is_self).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ts, order, text))), lambda s: s[text]), "\n").alias("text"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def exchanges(blocks: DataFrame, conv: str, is_self: str, reply_min: float = 30, most_words: int = 200) -> DataFrame:
    """Each block of others with the own block after it, with the reasons that stop it."""
    w = Window.partitionBy(conv).orderBy("block")
    nxt = {c: F.lead(c).over(w) for c in (is_self, "text", "first_ts")}
    x = blocks.withColumns({"n_self": nxt[is_self], "reply": nxt["text"], "reply_ts": nxt["first_ts"]}).filter(~F.col(is_self) & F.col("n_self"))
    gap = (F.unix_micros("reply_ts") - F.unix_micros("last_ts")) / 60e6
    return x.select(conv, "block", F.col("text").alias("user"), "reply", (gap > reply_min).alias("desync"), ((word_count("text") > most_words) | (word_count("reply") > most_words)).alias("too_long"), F.endswith("reply", F.lit("?")).alias("asks"))


def _starts(x: DataFrame) -> DataFrame:
    """Of rows (conv, pos, next, first) those that the walk reaches which begins at `first` and goes on at `next`.

    Pointer doubling: each round adds what lies one jump of the current length away and doubles the jumps, so the number
    of rounds grows with the logarithm of the longest walk; no conversation is gathered in one row.
    """
    jumps = stage(x.filter("next is not null").select("conv", "pos", "next"), "jumps")
    reached = stage(x.filter("first").select("conv", "pos"), "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps, ["conv", "pos"]).select("conv", F.col("next").alias("pos"))
        reached = stage(reached.unionByName(more).distinct(), "reached")
        jumps = stage(jumps.join(jumps.select("conv", F.col("pos").alias("next"), F.col("next").alias("far")), ["conv", "next"]).select("conv", "pos", F.col("far").alias("next")), "jumps")
    return reached


def training_pairs(df: DataFrame, conv: str, ts: str, order: str, is_self: str, text: str, max_turns: int = 1, reply_min: float = 30, most_words: int = 200, system: str | None = None) -> DataFrame:
    """Q1: examples of up to max_turns exchanges, going on while the reply asks (to a hard end), stopping at late or
    long ones: (conv, start, messages).

    Where an example that begins at an exchange ends is a window over the exchanges after it, so each exchange knows
    where the next example would begin; which of these are begun is found by following the pointers (_starts).
    """
    e = exchanges(turn_blocks(df, conv, ts, order, is_self, text), conv, is_self, reply_min, most_words)
    hard = max(3 * max_turns, 10)
    w = Window.partitionBy("conv").orderBy("block")
    x = e.select(F.col(conv).alias("conv"), "block", "user", "reply", (F.col("desync") | F.col("too_long")).alias("bad"), F.coalesce("asks", F.lit(False)).alias("asks"))
    x = x.withColumn("run", F.sum(F.col("bad").cast("int")).over(w)).filter("not bad").withColumn("pos", F.row_number().over(w))
    r = Window.partitionBy("conv", "run").orderBy("pos")
    x = x.withColumns({"enough": F.min(F.when(~F.col("asks"), F.col("pos"))).over(r.rowsBetween(0, Window.unboundedFollowing)), "first": F.row_number().over(r) == 1})
    last = F.max("pos").over(Window.partitionBy("conv", "run"))
    # least() passes over nulls: no exchange without a question is left, or none that far
    x = stage(x.withColumn("end", F.least(F.lead("enough", max_turns - 1).over(r), F.col("pos") + hard - 1, last)).withColumn("next", F.when(F.col("end") < last, F.col("end") + 1)), "walk")
    began = _starts(x).withColumn("began", F.lit(True))
    x = x.join(began, ["conv", "pos"], "left").withColumn("start", F.last(F.when(F.col("began"), F.col("block")), ignorenulls=True).over(w))
    g = x.groupBy("conv", "start").agg(F.array_sort(F.collect_list(F.struct("block", "user", "reply"))).alias("es"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    head = F.array(turn("system", F.lit(system))) if system else F.array().cast(MESSAGES)
    messages = F.concat(head, F.flatten(F.transform("es", lambda s: F.array(turn("user", s["user"]), turn("assistant", s["reply"])))))
    return g.select(F.col("conv").alias(conv), F.col("start").cast("int").alias("start"), messages.alias("messages"))


def skipped_exchanges(df: DataFrame, conv: str, ts: str, order: str, is_self: str, text: str, reply_min: float = 30, most_words: int = 200) -> DataFrame:
    """Q1's report: exchanges of each conversation, and how many were left out for a late reply or else for length."""
    e = exchanges(turn_blocks(df, conv, ts, order, is_self, text), conv, is_self, reply_min, most_words)
    return e.groupBy(conv).agg(F.count("*").alias("exchanges"), F.count_if("desync").alias("desync"), F.count_if(F.col("too_long") & ~F.col("desync")).alias("too_long"))


def prepare(df: DataFrame, most: int, system: str | None = None, length: Callable[[Column], Column] = word_count) -> DataFrame:
    """Q2: cleaned examples with a template text and its length; over-long ones are split into pairs, over-long pairs dropped."""
    m = merge_roles(F.filter("messages", lambda x: F.coalesce(x["content"], F.lit("")) != ""))
    x = df.withColumn("messages", m).filter(F.size("messages") > 0)
    if system:
        has = F.get("messages", 0)["role"] == "system"
        x = x.withColumn("messages", F.when(has, F.col("messages")).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), "messages")))
    text = F.array_join(F.transform("messages", lambda y: F.concat(F.lit("<|"), y["role"], F.lit("|> "), y["content"])), "\n")
    x = x.withColumn("text", text).withColumn("length", length(F.col("text")))
    pair = F.posexplode("messages")
    p = x.filter(F.col("length") > most).select("conv_id", "messages", pair.alias("pos", "m"))
    p = p.select("conv_id", "pos", "m", F.get("messages", F.col("pos") + 1).alias("after")).filter((F.col("m.role") == "user") & (F.col("after.role") == "assistant"))
    p = p.select("conv_id", F.array("m", "after").alias("messages")).withColumn("text", text).withColumn("length", length(F.col("text"))).filter(F.col("length") <= most)
    return x.filter(F.col("length") <= most).select("conv_id", "messages", "text", "length").unionByName(p.select("conv_id", "messages", "text", "length"))


def length_stats(df: DataFrame, n: str, limit: int) -> DataFrame:
    """A26."""
    return df.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.count_if(F.col(n) > limit).alias("over"))


def role_patterns(df: DataFrame, messages: str = "messages", n: int = 10) -> DataFrame:
    """A27, T13."""
    c = df.groupBy(role_sequence(messages).alias("pattern")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))  # one row
    return c.join(F.broadcast(total)).select("pattern", "n", F.bround(F.col("n") / F.col("t") * 100, 1).alias("pct")).orderBy(F.desc("n"), "pattern").limit(n)


def diagnostics(df: DataFrame, messages: str = "messages") -> DataFrame:
    """A28."""
    roles = F.transform(messages, lambda m: m["role"])
    same = F.exists(F.transform(roles, lambda r, i: r == F.get(roles, i + 1)), lambda b: F.coalesce(b, F.lit(False)))
    marks = F.exists(messages, lambda m: m["content"].rlike(r"<\|[a-z_]+\|>|</s>|\[INST\]"))
    return df.agg(F.count("*").alias("examples"), F.count_if(F.element_at(roles, -1) == "user").alias("ends_with_user"), F.count_if(same).alias("adjacent_same_role"), F.count_if(marks).alias("with_markers"), F.count_if(F.get(roles, 0) == "system").alias("with_system"))


def text_diagnostics(df: DataFrame, text: str, order: str, special: list[str] | None = None, eos: str | None = None, first: int = 10) -> DataFrame:
    """On formatted texts: whether the first ones show roles and ends of turns, how many hold no special token, and
    whether these are over half."""
    has = lambda keys: reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keys], F.lit(False))
    head = top_rows(df.select(order, text), first, order).agg(F.coalesce(F.max(has(V.ROLE_MARKS)), F.lit(False)).alias("roles_shown"), F.coalesce(F.max(has([eos] * bool(eos) + V.TURN_ENDS)), F.lit(False)).alias("ends_shown"))
    words = [x for x in special or [] if x.strip()]
    bare = df.agg(F.count("*").alias("examples"), (F.count_if(~has(words)) if words else F.lit(0).cast("long")).alias("without_special"))
    return head.crossJoin(bare).withColumn("mostly_bare", F.col("without_special") > 0.5 * F.col("examples"))  # one row each


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def export_stats(df: DataFrame, reason: Column) -> DataFrame:
    """Rows by the reason that left them out, or kept."""
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def export_summary(df: DataFrame, pairs: DataFrame, reason: Column, conversation: str = "conversation") -> DataFrame:
    """Messages, those left out, examples made of the rest, and the conversations these come from."""
    m = df.agg(F.count("*").alias("total_messages"), F.count_if(reason != "kept").alias("filtered_messages"))
    p = pairs.agg(F.count("*").alias("pairs_exported"), F.countDistinct(conversation).alias("conversations_used"))
    return m.crossJoin(p)  # one row each


def inspect(df: DataFrame, limit: int = 2048) -> dict[str, DataFrame]:
    """Q3: the reports on a set of examples (conv_id, messages)."""
    words = F.aggregate("messages", F.lit(0), lambda s, m: s + word_count(m["content"]))
    x = df.withColumn("words", words)
    return {"lengths": length_stats(x, "words", limit), "patterns": role_patterns(x), "diagnostics": diagnostics(x)}
