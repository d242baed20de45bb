"""V2, K3: a kept index of vectors in cells around centres, with exact answers, and upserts by id.

Tables of a store:
  vectors  the rows, and each vector's distance to its cell's centre (radius)   bucket: the cell
  places   id and cell                                                          bucket by id
  cells    cell, centre, largest radius, number of rows                         one bucket

Centres come from k-means on at most SAMPLE rows of the first batch; every row is assigned and kept. A row of a cell is
no nearer to a question than the question's distance to the centre less the cell's radius (and no nearer than the
difference of the two distances), so a question reads the nearest cells, then those that could still hold a nearer row.

Defined cases: vectors that are null, of another length than the first batch's, or hold a null or non-finite component
aren't indexed, and don't replace; a null id isn't indexed; of several rows of one id in a batch that with the greatest
vector counts; ties in distance go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Change, Store, bucket_of, buckets_in
from .cluster import sample_rows
from .search import distance, top

#: Rows that centres are fitted on, and cells that a question reads at least.
SAMPLE, PROBE = 20_000, 2


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, cells: int = 64, id_: str = "id", vector: str = "embedding"):
        self.spark, self.store, self.cells, self.id, self.vector = spark, Store(spark, root, cells), cells, id_, vector

    def _usable(self, rows: DataFrame, width: int) -> DataFrame:
        v = F.col(self.vector)
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        x = rows.filter(F.col(self.id).isNotNull() & (F.size(v) == width) & ~bad)
        first = F.row_number().over(Window.partitionBy(self.id).orderBy(F.desc(self.vector)))
        return x.withColumn("__r", first).filter("__r = 1").drop("__r")

    def _fit(self, rows: DataFrame) -> list[list[float]]:
        drawn = sample_rows(rows, self.id, SAMPLE).select(array_to_vector(F.transform(self.vector, lambda x: x.cast("double"))).alias("v")).persist()
        model = KMeans(featuresCol="v", k=max(2, self.cells), seed=42, maxIter=20).fit(drawn)
        drawn.unpersist()
        return [c.tolist() for c in model.clusterCenters()]

    def _placed(self, rows: DataFrame, centres: list[list[float]]) -> DataFrame:
        """rows with their cell (bucket) and radius."""
        names, at = rows.columns, rows.columns.index(self.vector)
        c = np.array(centres)

        def near(batches):
            for b in batches:
                col = b.column(at)
                x = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, c.shape[1])
                cell = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
                radius = np.sqrt(((x - c[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(radius), pa.array(cell.astype(np.int32))], [*names, "radius", "bucket"])

        schema = rows.withColumns({"radius": F.lit(0.0), "bucket": F.lit(0)}).schema
        return rows.mapInArrow(near, schema)

    def upsert(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> dict:
        """The index with `rows`; a row whose id is there already takes its place. Cells without a row that changes stay as they are."""
        store, state = self.store, self.store.state()
        if state and store.applied(writer, batch, state):
            return state
        if state is None:
            some = rows.filter(F.col(self.vector).isNotNull() & (F.size(self.vector) > 0)).select(F.size(self.vector).alias("n")).first()
            if some is None:
                raise ValueError("the first batch holds no vector")
            rows = self._usable(rows, some["n"])
            centres = self._fit(rows)
        else:
            centres = [r["centre"] for r in store.read("cells", state=state).orderBy("cell").collect()]
            rows = self._usable(rows, len(centres[0]))
        new = self._placed(rows, centres)
        id_, kind = F.col(self.id), rows.schema[self.id].dataType.simpleString()
        place = new.select(id_, F.col("bucket").alias("cell"), bucket_of(store.buckets, self.id).alias("bucket"))
        known = store.read("places", state=state, kind=f"`{self.id}` {kind}, cell int").join(new.select(self.id), self.id, "left_semi")
        moved = [r["cell"] for r in known.select("cell").distinct().collect()]  # cells at most
        changes = []
        if moved:
            kept = store.read("vectors", moved, state).join(new.select(self.id), self.id, "left_anti")
            inside = F.col("bucket").isin(moved)
            changes.append(Change("vectors", kept.unionByName(new.filter(inside)), moved, ("radius",)))
            changes.append(Change("vectors", new.filter(~inside), (), ("radius",)))
            touched = buckets_in(known)
            changes.append(Change("places", store.read("places", touched, state).join(place.select(self.id), self.id, "left_anti").unionByName(place.filter(F.col("bucket").isin(touched))), touched, (self.id,)))
            changes.append(Change("places", place.filter(~F.col("bucket").isin(touched)), (), (self.id,)))
        else:
            changes += [Change("vectors", new, (), ("radius",)), Change("places", place, (), (self.id,))]
        first = self.spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>")
        old = store.read("vectors", state=state, kind="radius double").select("bucket", "radius")
        same = old.filter(~F.col("bucket").isin(moved)) if moved else old
        rest = [same] + [c.rows.select("bucket", "radius") for c in changes if c.table == "vectors"]
        size = rest[0]
        for x in rest[1:]:
            size = size.unionByName(x)
        size = size.groupBy(F.col("bucket").alias("cell")).agg(F.max("radius").alias("far"), F.count("*").alias("n"))
        cells = first.join(size, "cell", "left").select("cell", "centre", F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(0).alias("bucket"))
        changes.append(Change("cells", cells, [0], ("cell",)))
        return store.commit(changes, {}, writer, batch, state)

    def search(self, question: list[float], n: int, condition: Column | None = None, read: list | None = None) -> DataFrame:
        """The first n rows by squared Euclidean distance, then id, of those that the condition keeps.

        read: is filled with the cells that were read."""
        state = self.store.state()
        cells = self.store.read("cells", state=state).filter("n > 0").select("cell", "centre", "far", "n").collect()
        gap = {r["cell"]: float(np.sqrt(((np.array(r["centre"]) - np.array(question)) ** 2).sum())) for r in cells}
        near = sorted(cells, key=lambda r: gap[r["cell"]])
        take, held = [], 0
        for r in near:
            if held >= n and len(take) >= PROBE:
                break
            take.append(r["cell"])
            held += r["n"]

        def inside(which: list[int], reach: float) -> DataFrame:
            x = self.store.read("vectors", which, state)
            if reach < float("inf"):  # rows that the triangle leaves possible, cell by cell
                ring = F.lit(False)
                for c in which:
                    ring = ring | ((F.col("bucket") == c) & F.col("radius").between(gap[c] - reach, gap[c] + reach))
                x = x.filter(ring)
            x = x if condition is None else x.filter(condition)
            return top(x.drop("radius", "bucket").withColumn("distance", distance(self.vector, question)), n, "distance", self.id)

        best = inside(take, float("inf"))
        got = [r["distance"] for r in best.select("distance").collect()]
        # a hair more than the n-th distance, for rounding
        reach = float(np.sqrt(max(got))) * (1 + 1e-9) + 1e-12 if len(got) == n else float("inf")
        more = [r["cell"] for r in near[len(take) :] if gap[r["cell"]] - r["far"] <= reach]
        if read is not None:
            read += [*take, *more]
        return top(best.unionByName(inside(more, reach)), n, "distance", self.id) if more else best
