"""The property graph kept on disk; merges change the buckets of the nodes they touch.

Tables of a store:
  node_props  label, name, property, last value and when it was set    bucket by node
  nodes       label, name, props                                       bucket by node
  edge_props  end points, type, since, property, last value and when   bucket by the node it leaves
  halves      each edge as seen from either end (EDGE columns turned so that the owner stands in from_*), outgoing, props
              bucket by owner

The last value of a property is decided by (merge, seq), so a later merge wins over an earlier one and seq within one;
whatever way rows are split into successive merges, the graph is that of one fold (graph.merge_nodes, merge_edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Change, Store, bucket_of, buckets_in, stage
from .graph import EDGE, merge_edges, merge_nodes

NODE = ["label", "name"]
WHEN = "struct<merge:bigint,seq:bigint>"
#: Nodes whose edges are asked for that are sent to all tasks.
SEEDS = 100_000
TURN = {"from_label": "to_label", "from_name": "to_name", "to_label": "from_label", "to_name": "from_name"}


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, at, value: of each property the value set last; a row without properties has a null k."""
    return rows.groupBy(*keys, "k").agg(F.max(F.struct("at", "value")).alias("v")).select(*keys, "k", "v.at", "v.value")


def _split(rows: DataFrame, keys: list[str], merge: int) -> DataFrame:
    x = rows.select(*keys, F.struct(F.lit(merge).cast("long").alias("merge"), F.col("seq").cast("long").alias("seq")).alias("at"), F.explode_outer(F.map_entries("props")).alias("e"))
    return x.select(*keys, F.col("e.key").alias("k"), "at", F.col("e.value").alias("value"))


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, Store(spark, root, buckets)

    def _of(self, prefix: str = ""):
        return bucket_of(self.store.buckets, f"{prefix}label", f"{prefix}name")

    def merge(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, writer: str | None = None, batch: int | None = None) -> dict:
        """Lays rows of nodes (label, name, props, seq) and edges (EDGE, props, seq) over the graph; end points become
        nodes. A batch that the writer has merged already changes nothing."""
        store, state = self.store, self.store.state()
        if state and store.applied(writer, batch, state):
            return state
        at = (state or {"version": 0})["version"] + 1
        changes, more = [], []
        if nodes is not None:
            more.append(_split(nodes.withColumn("name", F.trim("name")), NODE, at))
        if edges is not None:
            e = edges.withColumns({"from_name": F.trim("from_name"), "to_name": F.trim("to_name")})
            ends = [e.select(F.col(f"{s}_label").alias("label"), F.col(f"{s}_name").alias("name")) for s in ("from", "to")]
            bare = ends[0].union(ends[1]).distinct().select("*", F.lit(None).cast("string").alias("k"), F.struct(F.lit(at).cast("long").alias("merge"), F.lit(0).cast("long").alias("seq")).alias("at"), F.lit(None).cast("string").alias("value"))
            more.append(bare)
            changes += self._edges(_split(e.withColumn("since", F.coalesce(F.col("props")["since"], F.lit(""))), [*EDGE, "since"], at), state)
        # end points alone are one row each already
        delta = more[0] if nodes is None else _last(more[0] if edges is None else more[0].unionByName(more[1]), NODE)
        props, touched = self._laid("node_props", delta.withColumn("bucket", self._of()), NODE, state)
        pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "value")))
        view = props.groupBy(*NODE).agg(F.map_from_entries(F.array_sort(pairs)).cast("map<string,string>").alias("props")).withColumn("bucket", self._of())
        changes += [Change("node_props", props, touched, tuple(NODE)), Change("nodes", view, touched, tuple(NODE))]
        return store.commit(changes, {}, writer, batch, state)

    def _laid(self, table: str, delta: DataFrame, keys: list[str], state: dict | None) -> tuple[DataFrame, list[int]]:
        """delta laid over the buckets it touches, written once for all that derives from it; and these buckets."""
        delta = stage(delta, table)
        if not state or table not in state["tables"]:
            return delta, []
        touched = buckets_in(delta)
        old = self.store.read(table, touched, state)
        bucket = self._of("from_") if "from_label" in keys else self._of()
        return stage(_last(old.unionByName(delta.select(*old.columns)), keys).withColumn("bucket", bucket), table), touched

    def _edges(self, delta: DataFrame, state: dict | None) -> list[Change]:
        keys = [*EDGE, "since"]
        props, touched = self._laid("edge_props", _last(delta, keys).withColumn("bucket", self._of("from_")), keys, state)
        there = bool(state) and "halves" in state["tables"]
        changed = stage(delta.select(*EDGE).distinct(), "changed") if there else None
        # what merge_edges reads: one row a property, which names the edge's date
        date, own = F.create_map(F.lit("since"), F.col("since")), F.create_map("k", "value")
        dated = F.col("since") != ""
        rows = (props.join(changed, EDGE, "left_semi") if there else props).select(*EDGE, F.when(dated & (F.coalesce(F.col("k"), F.lit("since")) == "since"), date).when(dated, F.map_concat(date, own)).when(F.col("k").isNotNull(), own).alias("props"), F.col("at").alias("seq"))
        view = stage(merge_edges(rows).select(*EDGE, "since", "props"), "edges")
        loop = (F.col("from_label") == F.col("to_label")) & (F.col("from_name") == F.col("to_name"))
        back = view.filter(~loop).select(*[F.col(TURN.get(c, c)).alias(c) for c in view.columns], F.lit(False).alias("outgoing"))
        halves = view.withColumn("outgoing", F.lit(True)).unionByName(back).withColumn("bucket", self._of("from_"))
        if not there:
            return [Change("edge_props", props, touched, tuple(EDGE)), Change("halves", halves, (), tuple(EDGE))]
        gone = changed.withColumn("outgoing", F.lit(True)).unionByName(changed.select(*[F.col(TURN.get(c, c)).alias(c) for c in EDGE], F.lit(False).alias("outgoing")))
        owners = buckets_in(gone.withColumn("bucket", self._of("from_")))
        kind = ", ".join(f"{c} string" for c in keys) + ", props map<string,string>, outgoing boolean"
        kept = self.store.read("halves", owners, state, kind).join(gone, [*EDGE, "outgoing"], "left_anti")
        return [Change("edge_props", props, touched, tuple(EDGE)), Change("halves", kept.unionByName(halves), owners, tuple(EDGE))]

    def nodes(self) -> DataFrame:
        return self.store.read("nodes", kind="label string, name string, props map<string,string>").drop("bucket")

    def both_ways(self) -> DataFrame:
        """J8 of all nodes: each edge from either end, a self-loop once."""
        return self.store.read("halves", kind=", ".join(f"{c} string" for c in [*EDGE, "since"]) + ", props map<string,string>, outgoing boolean").drop("bucket")

    def edges(self) -> DataFrame:
        return self.both_ways().filter("outgoing").drop("outgoing")

    def expand(self, seeds: DataFrame) -> DataFrame:
        """J8 of some nodes (label, name): their edges from their side. Reads the seeds' buckets; edges aren't shuffled
        unless there are more than SEEDS nodes."""
        asked = seeds.select(F.col("label").alias("from_label"), F.col("name").alias("from_name")).distinct()
        few = asked.limit(SEEDS + 1).count() <= SEEDS
        held = self.store.read("halves", buckets_in(asked.withColumn("bucket", self._of("from_"))) if few else None).drop("bucket")
        return held.join(F.broadcast(asked) if few else asked, ["from_label", "from_name"]).select(*held.columns)
