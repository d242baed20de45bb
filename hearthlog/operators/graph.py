"""The property graph as tables: merges of nodes and edges, and reads.

edges: from_label, from_name, rel_type, to_label, to_name, props map<string,string>, seq; nodes: label, name, props.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relation_label

EDGE = ["from_label", "from_name", "rel_type", "to_label", "to_name"]


#: Labels whose size or degree is a sum of a property of edges that come in, by edge type.
SUMMED_SIZE = {"Activity": ("INTERESTED_IN", "activity_count")}
SUMMED_DEGREE = SUMMED_SIZE | {"Artist": ("LISTENED_TO", "play_count"), "Song": ("LISTENED_TO", "play_count")}
#: Labels whose size is the number of different targets of an edge type, whatever their own label.
TARGETS = {"Interest": "INTERESTED_IN"}


def overlay(rows: DataFrame, keys: list[str], props: str = "props", seq: str = "seq") -> DataFrame:
    """keys and props: the maps of a group laid over one another in order, later values winning, others kept.

    Each property's last value is found by itself, pre-aggregated, so a node with very many rows isn't gathered.
    """
    e = rows.select(*keys, F.col(seq).alias("s"), F.explode_outer(F.map_entries(props)).alias("e"))
    last = e.groupBy(*keys, F.col("e.key").alias("k")).agg(F.max(F.struct("s", "e.value")).alias("v"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v.value")))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).cast("map<string,string>").alias(props))


def merge_nodes(rows: DataFrame) -> DataFrame:
    """K5, K7: a node per label and trimmed name."""
    return overlay(rows.withColumn("name", F.trim("name")), ["label", "name"])


def merge_edges(rows: DataFrame) -> DataFrame:
    """K6: an edge per end points, type and (where given) `since`. An edge row without `since` lays its properties
    over every edge of that type between the two, as a pattern without it matches them all."""
    x = rows.withColumn("from_name", F.trim("from_name")).withColumn("to_name", F.trim("to_name")).withColumn("since", F.coalesce(F.col("props")["since"], F.lit("")))
    dated = x.filter("since <> ''").select(*EDGE, "since").distinct()
    # of many rows without `since` the last value of each property is all that is laid over the dated edges
    undated = x.filter("since = ''").select(*EDGE, "seq", F.explode_outer(F.map_entries("props")).alias("e"))
    undated = undated.groupBy(*EDGE, F.col("e.key").alias("k")).agg(F.max(F.struct("seq", "e.value")).alias("v"))
    undated = undated.select(*EDGE, F.col("v.seq").alias("seq"), F.when(F.col("k").isNotNull(), F.create_map("k", "v.value")).alias("props"))
    fanned = undated.join(dated.withColumnRenamed("since", "since2"), EDGE, "left").select(*EDGE, "seq", "props", F.coalesce("since2", F.lit("")).alias("since"))
    return overlay(x.filter("since <> ''").select(*EDGE, "seq", "props", "since").unionByName(fanned), [*EDGE, "since"])


def add_node(nodes: DataFrame, label: str, name: str) -> DataFrame:
    """Nodes (label, name, props) with one more, entered by hand; an empty name is an error."""
    if not name.strip():
        raise ValueError("a node needs a name")
    one = nodes.sparkSession.createDataFrame([(label, name, {})], "label string, name string, props map<string,string>")
    return merge_nodes(nodes.select("label", "name", "props", F.lit(0).alias("seq")).unionByName(one.withColumn("seq", F.lit(1))))


def add_edge(edges: DataFrame, from_label: str, from_name: str, rel: str, to_label: str, to_name: str) -> DataFrame:
    """Edges (EDGE, props) with one more between two named nodes."""
    if not from_name.strip() or not to_name.strip():
        raise ValueError("an edge needs the names of both nodes")
    one = edges.sparkSession.createDataFrame([(from_label, from_name, rel, to_label, to_name, {})], ", ".join(f"{c} string" for c in EDGE) + ", props map<string,string>")
    return merge_edges(edges.select(*EDGE, "props", F.lit(0).alias("seq")).unionByName(one.withColumn("seq", F.lit(1))))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_label").alias("label"), F.col("from_name").alias("name")).unionByName(edges.select(F.col("to_label").alias("label"), F.col("to_name").alias("name"))).distinct()


def upsert(rows: DataFrame, keys: list[str], seq: str = "seq", first_wins: bool = True) -> DataFrame:
    """K8, K9: one row per key, the first or the last written."""
    pick = F.min_by if first_wins else F.max_by
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*cols), F.col(seq)).alias("x")).select(*keys, "x.*")


def distinct_triples(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """First of each (from, type, to, since)."""
    w = Window.partitionBy("from_name", "rel_type", "to_name", F.coalesce(F.col("props")["since"], F.lit(""))).orderBy(seq)
    return edges.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end; a self-loop once."""
    turned = edges.filter(~((F.col("from_label") == F.col("to_label")) & (F.col("from_name") == F.col("to_name"))))
    swap = {"from_label": "to_label", "from_name": "to_name", "to_label": "from_label", "to_name": "from_name"}
    back = turned.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def neighbours(edges: DataFrame, name: str, n: int = 50) -> DataFrame:
    """T8, in a defined order."""
    return both_ways(edges).filter(F.col("from_name") == name).select("rel_type", "to_label", "to_name").orderBy("rel_type", "to_label", "to_name").limit(n)


def typed(edges: DataFrame, from_label: str, rel: str, to_label: str) -> DataFrame:
    """J9."""
    return edges.filter((F.col("from_label") == from_label) & (F.col("rel_type") == rel) & (F.col("to_label") == to_label))


def _amount(edges: DataFrame, summed: dict) -> DataFrame:
    """(label, name, amount) of the targets of edges whose property counts, by `summed`."""
    prop = F.lit(None).cast("string")
    for label, (rel, key) in summed.items():
        prop = F.when((F.col("to_label") == label) & (F.col("rel_type") == rel), F.coalesce(F.col("props")[key], F.lit("0"))).otherwise(prop)
    x = edges.select(F.col("to_label").alias("label"), F.col("to_name").alias("name"), prop.try_cast("double").cast("long").alias("amount"), prop.isNotNull().alias("own"))
    return x.filter("own").groupBy("label", "name").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))


def degree(nodes: DataFrame, edges: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Edges of each node, 0 for those without; for some labels the sum of a property of edges coming in."""
    d = both_ways(edges).groupBy(F.col("from_label").alias("label"), F.col("from_name").alias("name")).agg(F.count("*").alias("degree"))
    x = nodes.select("label", "name").join(d, ["label", "name"], "left").join(_amount(edges, SUMMED_DEGREE), ["label", "name"], "left")
    x = x.select("label", "name", F.coalesce(F.when(F.col("label").isin(*SUMMED_DEGREE), F.coalesce("amount", F.lit(0))), F.col("degree"), F.lit(0)).alias("degree"))
    return x.filter(~F.upper("name").isin(*[e.upper() for e in exclude])) if exclude else x


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by label and edges by type; some labels count a property's sum or an edge type's targets instead."""
    plain = nodes.filter(~F.col("label").isin(*TARGETS, *SUMMED_SIZE)).groupBy("label").agg(F.count("*").alias("n"))
    none = nodes.filter(F.col("label").isin(*SUMMED_SIZE)).select("label", F.lit(0).cast("long").alias("n"))
    summed = _amount(edges, SUMMED_SIZE).select("label", F.col("amount").alias("n")).unionByName(none).groupBy("label").agg(F.sum("n").alias("n"))
    out = plain.unionByName(summed)
    for label, rel in TARGETS.items():
        out = out.unionByName(edges.filter(F.col("rel_type") == rel).select("to_label", "to_name").distinct().groupBy(F.lit(label).alias("label")).agg(F.count("*").alias("n")))
    by_type = edges.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n"))
    return out.select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n").unionByName(by_type)


def interest_profile(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Share of each target's weight; a missing weight is 1."""
    w = edges.groupBy("to_name").agg(F.sum(F.coalesce(weight, F.lit(1.0))).alias("w"))
    total = w.agg(F.sum("w").alias("t"))  # one row
    return w.join(F.broadcast(total)).select("to_name", F.col("w").alias("weight"), F.bround(F.col("w") / F.col("t") * 100, 1).alias("pct"))


def search_nodes(nodes: DataFrame, term: str, n: int = 20) -> DataFrame:
    """T7."""
    return nodes.filter(F.contains(F.lower("name"), F.lit(term.lower()))).select("label", "name").orderBy("name", "label").limit(n)


def facts(edges: DataFrame, terms: list[str], n: int = 15) -> DataFrame:
    """Facts on each term, exact names first, then names of games and activities that contain it."""
    spark = edges.sparkSession
    t = spark.createDataFrame([(i, x.lower()) for i, x in enumerate(terms)], "pos int, term string")  # the question's terms
    e = both_ways(edges)
    exact = F.lower("from_name") == F.col("term")
    near = F.col("from_label").isin("Game", "Activity") & F.contains(F.lower("from_name"), F.col("term"))
    j = e.join(F.broadcast(t), exact | near).withColumn("score", F.when(exact, 1).otherwise(2))
    tie = F.concat_ws("|", "rel_type", "to_label", "to_name", "from_name")
    value = lambda k: F.col("props")[k]
    count = F.coalesce(value("sessions").cast("int"), value("count").cast("int"), F.lit(0))
    weight = F.coalesce(value("weight").cast("double"), F.lit(0.0))
    w = Window.partitionBy("pos").orderBy("score", F.desc(count), F.desc(weight), tie)
    top = j.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    more = F.array_compact(F.array(F.when(F.coalesce(value("since"), F.lit("")) != "", F.concat(F.lit("since "), value("since"))), F.when(weight > 0, F.concat(F.lit("weight: "), value("weight"))), F.when(count > 0, F.concat(F.lit("count: "), count.cast("string")))))
    fact = F.concat("from_name", F.lit(" "), relation_label("rel_type"), F.lit(" "), "to_name", F.lit(" ("), "to_label", F.lit(")"), F.when(F.size(more) > 0, F.concat(F.lit(" ["), F.array_join(more, " | "), F.lit("]"))).otherwise(""))
    return top.select(fact.alias("fact"), (F.col("pos") * 1000 + F.col("r")).alias("p")).groupBy("fact").agg(F.min("p").alias("pos")).orderBy("pos")


def top_skill(rows: DataFrame, key: str, value: Column, n: int = 5) -> DataFrame:
    """The first n of a table by a measure."""
    return rows.groupBy(key).agg(value.alias("value")).orderBy(F.desc("value"), key).limit(n)


def message_graph(messages: DataFrame) -> DataFrame:
    """Who sent what in which conversation, with stable ids."""
    m = F.sha2(F.concat_ws("|", "sender_name", F.col("date").cast("string"), "text"), 256)
    none = F.create_map().cast("map<string,string>")
    return messages.select(F.explode(F.array(
        F.struct(F.lit("Person").alias("from_label"), F.col("sender_name").alias("from_name"), F.lit("SENT").alias("rel_type"), F.lit("Message").alias("to_label"), m.alias("to_name"), none.alias("props")),
        F.struct(F.lit("Message").alias("from_label"), m.alias("from_name"), F.lit("IN_CONVERSATION").alias("rel_type"), F.lit("Conversation").alias("to_label"), F.col("conversation").alias("to_name"), none.alias("props")),
    )).alias("e")).select("e.*")


def triples(rows: DataFrame, specs: list[tuple]) -> DataFrame:
    """Edges of source rows; a spec is (from_label, from column, type, to_label, to column, {property: column})."""
    made = [F.struct(F.lit(a).alias("from_label"), F.col(b).cast("string").alias("from_name"), F.lit(r).alias("rel_type"), F.lit(c).alias("to_label"), F.col(d).cast("string").alias("to_name"),
                     (F.create_map(*[x for k, v in p.items() for x in (F.lit(k), F.col(v).cast("string"))]) if p else F.create_map()).cast("map<string,string>").alias("props")) for a, b, r, c, d, p in specs]
    return rows.select(F.explode(F.array(*made)).alias("e")).select("e.*").filter("from_name is not null and to_name is not null")
