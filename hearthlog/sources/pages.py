"""S1, S2, S8, S9 as a Spark data source: groups of files, typed columns, filters on folders and times that are pushed down.

    spark.dataSource.register(ExportFiles)
    spark.read.format("export").option("kind", "chat").load(path).filter("folder = 'ann_1' and date >= ...")

A filter on `folder` decides which files are listed into partitions; one on the kind's time column drops rows as they are
read. Needs spark.sql.python.filterPushdown.enabled (register() sets it); otherwise Spark filters what is read.
"""

from __future__ import annotations

import fnmatch
import gzip
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .exports import _Sections, calendar_events, first_point

GROUP = 32 << 20


def _sections(name: str, content: bytes) -> Iterator[tuple]:
    """(place, sender, stamp, text) of a page's sections."""
    parser = _Sections()
    parser.feed(content.decode("utf-8", "replace"))
    for i, r in enumerate(parser.rows):
        parts = [x for x in dict.fromkeys(r["body"]) if not x.startswith("IP Address:")]
        yield i, " ".join(r["sender"]), " ".join(r["stamp"]), " ".join(parts)


def _stamp(text: str) -> datetime | None:
    """`Jun 18, 2015 9:35:16 pm`, as text.chat_timestamp reads it."""
    try:
        return datetime.strptime(text.strip(), "%b %d, %Y %I:%M:%S %p")
    except ValueError:
        return None


def _chat(name: str, content: bytes) -> Iterator[tuple]:
    for i, sender, stamp, text in _sections(name, content):
        date = _stamp(stamp)
        if sender and text and date:
            yield i, sender, date, text


def _friends(name: str, content: bytes) -> Iterator[tuple]:
    for _, sender, stamp, _ in _sections(name, content):
        if sender not in ("", "Unknown"):
            yield sender, _stamp(stamp), stamp


def _tracks(name: str, content: bytes) -> Iterator[tuple]:
    yield first_point((gzip.decompress(content) if name.endswith(".gz") else content).decode("utf-8", "replace"))


def _calendar(name: str, content: bytes) -> Iterator[tuple]:
    yield from calendar_events(content.decode("utf-8", "replace"))


class Kind(NamedTuple):
    patterns: tuple[str, ...]
    columns: str
    parse: object
    time: str | None


KINDS = {
    "chat": Kind(("*.html",), "ord long, sender_name string, date timestamp_ntz, text string", _chat, "date"),
    "friends": Kind(("*.html",), "name string, since timestamp_ntz, stamp string", _friends, "since"),
    "track": Kind(("*.gpx", "*.tcx", "*.gpx.gz", "*.tcx.gz"), "lat double, lng double", _tracks, None),
    "calendar": Kind(("*.ics",), "id string, summary string, description string, location string, start timestamp_ntz, end timestamp_ntz", _calendar, "start"),
}


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class ExportReader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.path = KINDS[options.get("kind", "chat")], options["path"]
        self.patterns = tuple(options["pattern"].split(",")) if options.get("pattern") else self.kind.patterns
        self.group = int(options.get("groupBytes", GROUP))
        names = [c.split()[0] for c in self.kind.columns.split(", ")]
        self.time = names.index(self.kind.time) if self.kind.time else None
        self.folders: set | None = None
        self.bounds: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "folder" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.folders = wanted if self.folders is None else self.folders & wanted
            elif column == self.kind.time and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, datetime):
                self.bounds.append((type(f).__name__, f.value.replace(tzinfo=None)))
            else:
                yield f

    def _keeps(self, at: datetime | None) -> bool:
        if not self.bounds:
            return True
        test = {"GreaterThan": at.__gt__, "GreaterThanOrEqual": at.__ge__, "LessThan": at.__lt__, "LessThanOrEqual": at.__le__} if at else {}
        return at is not None and all(test[k](v) for k, v in self.bounds)

    def partitions(self):
        system, top = pafs.FileSystem.from_uri(self.path)
        groups, size = [[]], 0
        found = system.get_file_info(pafs.FileSelector(top, recursive=True))
        for f in sorted(found, key=lambda f: f.path):
            folder = f.path.rsplit("/", 2)[-2] if "/" in f.path else ""
            if f.type != pafs.FileType.File or not any(fnmatch.fnmatch(f.base_name, p) for p in self.patterns) or (self.folders is not None and folder not in self.folders):
                continue
            if size and size + f.size > self.group:
                groups.append([])
                size = 0
            groups[-1].append((f.path, folder))
            size += f.size
        return [Files(g) for g in groups]

    def read(self, partition):
        system, _ = pafs.FileSystem.from_uri(self.path)
        for name, folder in partition.names:
            with system.open_input_file(name) as f:
                content = f.read()
            for row in self.kind.parse(name, content):
                if self.time is None or self._keeps(row[self.time]):
                    yield (name, folder, *row)


class ExportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "export"

    def schema(self) -> str:
        return "path string, folder string, " + KINDS[self.options.get("kind", "chat")].columns

    def reader(self, schema) -> ExportReader:
        return ExportReader(self.options)


def export_files(spark: SparkSession, path: str, kind: str = "chat", **options) -> DataFrame:
    """(path, folder, columns of the kind): chat S1, friends S2, track S8, calendar S9.

    Spark keeps what it pushed into a loaded source and reads it again in a later scan that pushes nothing, so a filter
    that holds always is pushed with each; load the source anew for each filter of one query.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExportFiles)
    reader = spark.read.format("export").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path).filter("path is not null")
