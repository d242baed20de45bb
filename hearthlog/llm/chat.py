"""Chat formatting over reply trees (native).

Messages hang in trees: (tree, node, parent, role, text, score). Iterative self-joins by pointer doubling
take each node's pointer up to its root, in as many rounds as the logarithm of the depth; each root-to-leaf path is a
branch, ranked in its tree by the sum of its nodes' scores (ties: longer first, then smaller leaf), and each
chosen path is formatted as one conversation:

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

Inside roles and texts `&` becomes `&a;` and `<|` becomes `&l;|` (in roles a line feed becomes `&n;`), so no
text can open or close a turn, and read_back() restores every character. The loss mask is the list of
(start, length) of the assistant texts in the formatted string, in code points.

Defined cases: null text, role or score count as empty or 0; a parent that is not there makes its child a
root; a node that is its own ancestor is on no path; of rows of one node the least counts, once; a conversation's text
is one row, of any length; rows of one conversation with equal turns are ordered by
role, then text, and all stay; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, running, settle

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&a;")), F.lit("<|"), F.lit("&l;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&l;|"), F.lit("<|")), F.lit("&a;"), F.lit("&"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Reply trees of a table by turns: each row answers the one before it."""
    clean = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return clean.withColumn("node", F.row_number().over(w).cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _distinct(nodes: DataFrame) -> DataFrame:
    """One row of each node: of several the least by parent, role, text and score."""
    cols = [F.col("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")]
    return nodes.groupBy("tree", "node").agg(F.min(F.struct(*cols)).alias("x")).select("tree", "node", "x.*")


def paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, path): node ids from root to leaf, the `best` branches of each tree (None: all).

    A row (node, up, sum, depth) says which ancestor a node's pointer has reached and what lies below it. Each round
    joins every unfinished row with that of its `up`, which doubles its reach; pointers alone move, no paths. The
    pointers of each round stay as a table, and from these only the chosen leaves' paths are laid out, farthest
    jumps first: each round adds the jump of every node found so far.
    """
    n = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("x")).select("tree", "node", "x.*")
    known = n.select(F.col("tree").alias("kt"), F.col("node").alias("kn"))
    asked = n.filter("parent is not null").select(F.col("tree").alias("pt"), F.col("parent").alias("pn")).distinct()
    base = n.join(known, F.col("tree").eqNullSafe(F.col("kt")) & (F.col("parent") == F.col("kn")), "left").join(asked, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("node") == F.col("pn")), "left")
    rows = settle(base.select("tree", "node", F.when(F.col("kn").isNotNull(), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth"), F.col("pn").isNull().alias("is_leaf")), "steps")
    longest = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while not rows.filter("up is not null").isEmpty() and 1 << len(jumps) <= longest:
        # what is still on its way after as many steps as its tree has nodes runs in a circle
        open_ = rows.filter("up is not null")
        jumps.append(open_.select(F.col("tree").alias("t"), F.col("node").alias("n2"), F.col("up").alias("to")))
        above = rows.select(F.col("tree").alias("t"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("depth").alias("depth2"))
        far = open_.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n2"))).select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("depth") + F.col("depth2")).alias("depth"), "is_leaf")
        rows = settle(rows.filter("up is null").unionByName(far), "steps")
    leaves = rows.filter("is_leaf and up is null").select("tree", F.col("node").alias("leaf"), "sum", "depth")
    w = Window.partitionBy("tree").orderBy(F.desc("sum"), F.desc("depth"), "leaf")
    ranked = leaves.withColumn("rank", F.row_number().over(w))
    on_path = (ranked if best is None else ranked.filter(F.col("rank") <= best)).select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        on_path = settle(on_path, "path")
        more = on_path.join(jumps[k], F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n2"))).select("tree", "leaf", "rank", F.col("to").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        on_path = on_path.unionByName(more)
    return on_path.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "node"))).alias("p")).select("tree", "leaf", "rank", F.col("p.node").alias("path"))


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, mask): the chosen paths as conversations with their loss masks."""
    steps = chosen.select(F.col("tree").alias("t"), "leaf", "rank", F.posexplode("path").alias("pos", "n"))
    one = _distinct(nodes).select("tree", "node", "role", "text")
    turns = steps.join(one, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    parts = F.transform("turns", lambda m: F.struct(F.concat(F.lit(START), F.replace(escape(m["role"]), F.lit("\n"), F.lit("&n;")), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("own")))
    tail = f"{END}\n"
    x = turns.select("tree", "leaf", "rank", parts.alias("parts")).withColumn("sizes", F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail)))
    x = x.withColumn("starts", running(F.col("sizes"), F.lit(0), lambda a, n: a + n))
    mask = F.transform("parts", lambda p, i: F.struct(p["own"].alias("own"), (F.get("starts", i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))
    # named a second time, so the optimizer does not put the sums into the function, to be made for each turn
    mask = F.when(F.size("starts") > 0, F.transform(F.filter(mask, lambda m: m["own"]), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))))
    return x.select("tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"), mask.alias("mask"))


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    return format_paths(nodes, paths(nodes, best))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text) and the texts under the loss mask, restored from the string."""
    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(F.replace(role, F.lit("&n;"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    said = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)
    x = formatted.withColumn("__c", chunks(F.col("formatted")))
    return x.withColumns({"turns": F.transform(said, turn), "loss_texts": F.transform("mask", lambda m: unescape(cut(F.col("__c"), m["start"], m["start"] + m["length"])))}).drop("__c")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    r = read_back(formatted)
    loss = F.array_join("loss_texts", "")
    return r.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
