"""Tables kept on disk in buckets, changed by adding or replacing buckets, with one pointer to what is current.

A change writes new Parquet folders (generation=G/bucket=K) and never touches old ones; then a small file with the next
version number is put in place by a rename that fails if it is there already. Readers see the version they began with;
of two writers on one version one fails and may try again. A batch that a writer has applied isn't applied twice.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class Change(NamedTuple):
    """Rows (with a column `bucket`) that a table gains, or rows that write() has written. `replaced`: buckets whose rows so far go."""

    table: str
    rows: DataFrame | Written
    replaced: Iterable[int] = ()
    order: tuple[str, ...] = ()


class Written(NamedTuple):
    """Folders of a table that no version names yet."""

    table: str
    generation: str
    buckets: list[str]
    schema: dict


def bucket_of(n: int, *columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def dealt(tasks: int, buckets: int, *columns) -> Column:
    """The share of its bucket that a row belongs to where `tasks` partitions hold `buckets` buckets."""
    return F.pmod(F.xxhash64(F.lit("share"), *columns), F.lit(max(1, -(-tasks // buckets)))).cast("int")


def buckets_in(rows: DataFrame) -> list[int]:
    """The buckets that rows are in; as many as there are buckets at most."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        state = self.state()
        self.buckets = state["buckets"] if state else buckets

    # --- the pointer

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def state(self) -> dict | None:
        """What is current: version, buckets, tables, facts, and each writer's last batch."""
        names = [n for n in self._names(f"{self.root}/_versions") if n.endswith(".json")]
        if not names:
            return None
        stream = self._fs().open(self._path(f"{self.root}/_versions/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = f"{self.root}/_versions"
        temp, final = self._path(f"{folder}/{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/{state['version']:012d}.json")
        out = self._fs().create(temp, False)
        out.write(json.dumps(state).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(temp, final, none)
        except Exception as e:
            self._fs().delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {state['version']} of {self.root} is there already") from e
            raise

    # --- tables

    def read(self, table: str, buckets: Iterable[int] | None = None, state: dict | None = None, kind: str | None = None) -> DataFrame:
        """A table, or those of its buckets that are named: no other folder is looked at. kind: schema of a table that isn't there yet."""
        state = state or self.state() or {"tables": {}}
        held = state["tables"].get(table)
        if held is None:
            return self.spark.createDataFrame([], f"{kind}, bucket int")
        wanted = None if buckets is None else {int(b) for b in buckets}
        return self._folders(table, held["schema"], [(g, b) for b, gs in held["parts"].items() if wanted is None or int(b) in wanted for g in gs])

    def written(self, made: Written) -> DataFrame:
        """Rows that write() has written."""
        return self._folders(made.table, made.schema, [(made.generation, b) for b in made.buckets])

    def _folders(self, table: str, schema: dict, held: list[tuple[str, str]]) -> DataFrame:
        schema, paths = StructType.fromJson(schema), [f"{self.root}/{table}/generation={g}/bucket={b}" for g, b in held]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.names)

    def write(self, table: str, rows: DataFrame, order: tuple[str, ...] = (), generation: str | None = None, placed: bool = False, tasks: int = 0) -> Written:
        """Writes rows into new folders. placed: each bucket's rows stand in few partitions already and are not moved.
        tasks: partitions that share the buckets, each bucket dealt by `order`; 0: one a bucket."""
        own = generation or f"early-{uuid.uuid4().hex[:12]}"
        folder = f"{self.root}/{table}/generation={own}"
        names = [c for c in rows.columns if c != "bucket"]
        rows = rows.select(*names, F.col("bucket").cast("int").alias("bucket"))
        if not placed:
            rows = rows.repartition(tasks, "bucket", dealt(tasks, self.buckets, *order)) if tasks > self.buckets else rows.repartition(F.col("bucket"))
        rows.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(folder)
        return Written(table, own, [b.removeprefix("bucket=") for b in self._names(folder) if b.startswith("bucket=")], json.loads(rows.schema.json()))

    def commit(self, changes: list[Change], facts: dict | None = None, writer: str | None = None, batch: int | None = None, state: dict | None = None) -> dict:
        """Writes the changes and points to them. state: the version they were made from; facts are laid over those so far."""
        before = state or self.state() or {"version": 0, "buckets": self.buckets, "tables": {}, "facts": {}, "applied": {}}
        after = json.loads(json.dumps(before)) | {"version": before["version"] + 1}
        generation = f"{after['version']:08d}-{uuid.uuid4().hex[:8]}"
        for k, change in enumerate(changes):
            made = change.rows if isinstance(change.rows, Written) else self.write(change.table, change.rows, change.order, f"{generation}-{k}")
            held = after["tables"].setdefault(change.table, {"parts": {}})
            held["schema"] = made.schema
            for b in change.replaced:
                held["parts"].pop(str(b), None)
            for b in made.buckets:
                held["parts"].setdefault(b, []).append(made.generation)
        after["facts"] |= facts or {}
        if writer is not None:
            after["applied"][writer] = batch
        self._point(after)
        return after

    def applied(self, writer: str | None, batch: int | None, state: dict | None = None) -> bool:
        """Whether a writer's batch is in already; a writer's batches have growing numbers."""
        last = ((state or self.state() or {}).get("applied") or {}).get(writer)
        return writer is not None and last is not None and batch is not None and batch <= last

    def tidy(self) -> list[str]:
        """Deletes what no version but the current one names; for a time without readers of older versions and without writers."""
        state, gone, fs = self.state(), [], self._fs()
        if state is None:
            return gone
        for table, held in state["tables"].items():
            kept = {(g, b) for b, gs in held["parts"].items() for g in gs}
            for g in self._names(f"{self.root}/{table}"):
                for b in self._names(f"{self.root}/{table}/{g}"):
                    if b.startswith("bucket=") and (g.removeprefix("generation="), b.removeprefix("bucket=")) not in kept:
                        gone.append(f"{table}/{g}/{b}")
        gone += [f"_versions/{n}" for n in self._names(f"{self.root}/_versions") if n != f"{state['version']:012d}.json"]
        for p in gone:
            fs.delete(self._path(f"{self.root}/{p}"), True)
        return gone


#: Rows and bytes of one Arrow batch that Python tasks hold.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that a Python task's memory doesn't follow the number of rows it reads."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this session, in the folder that all machines share (spark.checkpoint.dir); deleted
    when the process ends. Where that is unset and Spark is one process, a local one becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="hearthlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not _made:
        atexit.register(_delete, spark)
    _made.append(f"{base.rstrip('/')}/hearthlog/{uuid.uuid4().hex}-{name}")
    return _made[-1]


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: everything that derives from it sees the same rows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; its folder goes with the others there
        return
    for p in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
