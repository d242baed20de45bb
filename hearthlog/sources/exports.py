"""Readers of personal-data exports and writers of results."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import activity_timestamp, chat_timestamp, partial_date, safe_double, safe_int
from .recurrence import in_utc, moment, occurrences

MESSAGE = "date string, sender_name string, source string, type string, text string, conversation string, language string"
PLAY = "ts string, ms_played long, platform string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string"


class _Sections(HTMLParser):
    """Sender, stamp and distinct text parts of each message section of a chat page."""

    PART = {"_a6-o": "stamp", "_a6-p": "body", "_a72d": "stamp"}

    def __init__(self):
        super().__init__()
        self.rows, self.stack, self.now = [], [], None

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        if tag == "section" and "_a6-g" in classes:
            self.now = {"sender": [], "stamp": [], "body": []}
        kind = "sender" if tag == "h2" else "skip" if tag == "ul" else next((self.PART[c] for c in classes if c in self.PART), None)
        self.stack.append((tag, kind or (self.stack[-1][1] if self.stack else None)))

    def handle_endtag(self, tag):
        while self.stack:
            t, _ = self.stack.pop()
            if t == tag:
                break
        if tag == "section" and self.now:
            self.rows.append(self.now)
            self.now = None

    def handle_data(self, data):
        kind = self.stack[-1][1] if self.stack else None
        if self.now is not None and kind in self.now and data.strip():
            self.now[kind].append(" ".join(data.split()))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def _sections(spark: SparkSession, path: str) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for p, content in zip(f["path"], f["content"]):
                h = _Sections()
                h.feed(bytes(content).decode("utf-8", "replace"))
                for i, r in enumerate(h.rows):
                    parts = [x for x in dict.fromkeys(r["body"]) if not x.startswith("IP Address:")]
                    out.append((p, i, " ".join(r["sender"]), " ".join(r["stamp"]), " ".join(parts)))
            yield pd.DataFrame(out, columns=["path", "ord", "sender_name", "stamp", "text"])

    return _files(spark, path, "*.html").select("path", "content").mapInPandas(run, "path string, ord long, sender_name string, stamp string, text string")


def chat_html(spark: SparkSession, path: str, source: str = "chat") -> DataFrame:
    """Messages of chat pages; sections without sender, date or text are left out."""
    x = _sections(spark, path).withColumn("date", chat_timestamp("stamp"))
    return x.filter("sender_name <> '' and text <> '' and date is not null").select("date", "sender_name", F.lit(source).alias("source"), "text", F.element_at(F.split("path", "/"), -2).alias("conversation"), "ord")


def friends_html(spark: SparkSession, path: str) -> DataFrame:
    """Names with their date, or the stamp as it is."""
    x = _sections(spark, path).filter("sender_name not in ('', 'Unknown')")
    return x.select(F.col("sender_name").alias("name"), F.coalesce(F.date_format(chat_timestamp("stamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.col("stamp")).alias("since"))


def messages_json(spark: SparkSession, path: str) -> DataFrame:
    """S3: an array of messages, bare or under chunks or messages."""
    item = f"struct<{', '.join(x.replace(' ', ':', 1) for x in MESSAGE.split(', '))}>"
    raw = spark.read.option("multiLine", True).schema(f"{MESSAGE}, chunks array<{item}>, messages array<{item}>").json(path)
    own = F.struct(*[c.split(" ")[0] for c in MESSAGE.split(", ")])
    return raw.select(F.explode(F.coalesce("chunks", "messages", F.array(own))).alias("m")).select("m.*").filter("date is not null or text is not null").fillna({"sender_name": "", "type": "text", "language": "en"})


def plays_json(spark: SparkSession, path: str) -> DataFrame:
    """Listening history."""
    x = spark.read.schema(PLAY).option("multiLine", True).json(path)
    title, artist = F.col("master_metadata_track_name"), F.col("master_metadata_album_artist_name")
    return x.select("ts", "ms_played", "platform", title.alias("title"), artist.alias("artist"), F.coalesce("master_metadata_album_album_name", F.lit("Unknown Album")).alias("album"), F.coalesce("spotify_track_uri", F.concat(title, F.lit(" — "), artist)).alias("uri"))


def lat_lng(c: Column) -> Column:
    """`48.1°, 2.3°` as a struct; null where malformed."""
    p = F.split(F.regexp_replace(c, "°", ""), r",\s*")
    return F.struct(F.get(p, 0).try_cast("double").alias("lat"), F.get(p, 1).try_cast("double").alias("lng"))


def locations_json(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of the modern (segments) and the legacy (E7) shape."""
    seg = "struct<startTime:string,endTime:string,visit:struct<topCandidate:struct<placeLocation:struct<latLng:string>>>,activity:struct<start:struct<latLng:string>,end:struct<latLng:string>,distanceMeters:double,topCandidate:struct<type:string>>>"
    raw = spark.read.option("multiLine", True).schema(f"semanticSegments array<{seg}>, locations array<struct<latitudeE7:long,longitudeE7:long,timestamp:string>>").json(path)
    new = raw.select(F.explode("semanticSegments").alias("s")).select(F.col("s.startTime").alias("ts"), F.col("s.endTime").alias("end_ts"), lat_lng(F.coalesce("s.visit.topCandidate.placeLocation.latLng", "s.activity.start.latLng")).alias("p"), F.col("s.activity.topCandidate.type").alias("mode"), F.col("s.activity.distanceMeters").alias("distance"))
    old = raw.select(F.explode("locations").alias("l")).select(F.col("l.timestamp").alias("ts"), F.lit(None).cast("string").alias("end_ts"), F.struct((F.col("l.latitudeE7") / 1e7).alias("lat"), (F.col("l.longitudeE7") / 1e7).alias("lng")).alias("p"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("double").alias("distance"))
    return new.unionByName(old).select(F.try_to_timestamp("ts").alias("ts"), F.try_to_timestamp("end_ts").alias("end_ts"), "p.lat", "p.lng", "mode", "distance")


def game_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Complete, parsable sessions with their seconds."""
    x = spark.read.option("header", True).schema("appid string, start_at string, end_at string").csv(path)
    t = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd HH:mm:ss"))
    x = x.select(F.trim("appid").alias("appid"), t("start_at").alias("start_at"), t("end_at").alias("end_at")).dropna().filter("appid <> ''")
    return x.withColumn("duration_s", F.greatest(F.lit(0), F.unix_seconds("end_at") - F.unix_seconds("start_at")))


def activities_csv(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    x = spark.read.option("header", True).csv(path)
    pick = lambda c: F.col(f"`{c}`") if c in x.columns else F.lit(None).cast("string")
    x = x.select(pick("Activity ID").alias("id"), pick("Activity Name").alias("name"), pick("Activity Type").alias("type"), pick("Activity Date").alias("d"), pick("Elapsed Time").alias("e"), pick("Distance").alias("km"), pick("Average Heart Rate").alias("hr"), pick("Calories").alias("cal"), pick("Start Latitude").alias("la"), pick("Start Longitude").alias("lo"), pick("Filename").alias("file"))
    return x.filter("id is not null").select("id", "name", "type", activity_timestamp("d").alias("date"), safe_int("e").alias("elapsed_s"), safe_double("km").alias("distance"), safe_double("hr").alias("heart_rate"), safe_double("cal").alias("calories"), safe_double("la").alias("lat"), safe_double("lo").alias("lng"), "file")


def first_point(text: str) -> tuple[float | None, float | None]:
    """Latitude and longitude of a track's first point."""
    m = re.search(r'<trkpt[^>]*?lat="([-0-9.]+)"[^>]*?lon="([-0-9.]+)"', text) or re.search(r"<LatitudeDegrees>\s*([-0-9.]+).*?<LongitudeDegrees>\s*([-0-9.]+)", text, re.S)
    return (float(m[1]), float(m[2])) if m else (None, None)


def gps_start(spark: SparkSession, path: str) -> DataFrame:
    """The first point of plain or packed tracks."""
    def text(p, content):
        raw = bytes(content)
        return (gzip.decompress(raw) if p.endswith(".gz") else raw).decode("utf-8", "replace")

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(p, *first_point(text(p, c))) for p, c in zip(f["path"], f["content"])], columns=["path", "lat", "lng"])

    return _files(spark, path, "*.{gpx,tcx,gpx.gz,tcx.gz}").select("path", "content").mapInPandas(run, "path string, lat double, lng double")


def calendar_events(text: str, first: str = "2000-01-01", last: str = "2030-12-31") -> Iterator[tuple]:
    """(id, summary, description, location, start, end) of a calendar's events with their recurrences between two
    days, less excluded and moved ones; no end means an hour. Times of a named zone become UTC; the id carries the local time.
    """
    lo, hi = datetime.fromisoformat(first), datetime.fromisoformat(last)
    found = []
    for e in re.findall(r"BEGIN:VEVENT(.*?)END:VEVENT", re.sub(r"\r?\n[ \t]", "", text), re.S):
        v, zone, dates = {}, None, {"EXDATE": [], "RDATE": []}
        for k, more, x in re.findall(r"^([A-Za-z-]+)((?:;[^:\r\n]*)?):(.*)$", e, re.M):
            if k.upper() in dates:
                dates[k.upper()] += [moment(d) for d in x.split(",") if d.strip()]
                continue
            v.setdefault(k.upper(), x.strip())
            if k.upper() == "DTSTART" and (m := re.search(r"(?i)TZID=\"?([^;\"]+)", more)):
                zone = m[1]
        if "DTSTART" in v:
            found.append((v, zone, dates))
    moved = {(v.get("UID"), moment(v["RECURRENCE-ID"])) for v, _, _ in found if "RECURRENCE-ID" in v}
    for v, zone, dates in found:
        start = moment(v["DTSTART"])
        long_ = moment(v["DTEND"]) - start if "DTEND" in v else timedelta(hours=1)
        gone = set(dates["EXDATE"]) | (set() if "RECURRENCE-ID" in v else {at for uid, at in moved if uid == v.get("UID")})
        for at in sorted({*occurrences(start, None if "RECURRENCE-ID" in v else v.get("RRULE"), hi), *dates["RDATE"]} - gone):
            if lo <= at <= hi:
                yield f"evt_{v.get('UID', '')}_{at:%Y%m%dT%H%M%S}", v.get("SUMMARY"), v.get("DESCRIPTION"), v.get("LOCATION"), in_utc(at, zone), in_utc(at + long_, zone)


def calendar_ics(spark: SparkSession, path: str, first: str = "2000-01-01", last: str = "2030-12-31") -> DataFrame:
    """The events of calendar files between two days."""
    def run(frames):
        for f in frames:
            out = [e for c in f["content"] for e in calendar_events(bytes(c).decode("utf-8", "replace"), first, last)]
            yield pd.DataFrame(out, columns=["id", "summary", "description", "location", "start", "end"])

    return _files(spark, path, "*.ics").select("content").mapInPandas(run, "id string, summary string, description string, location string, start timestamp, end timestamp")


def connections_csv(spark: SparkSession, path: str, most: int = 30) -> DataFrame:
    """A CSV under a note: lines up to the one that begins with `First Name` (within `most` lines) are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"))
    body = F.regexp_extract("t", rf"(?s)^(?:(?!First Name)[^\n]*\n){{0,{most}}}(First Name.*)$", 1)
    rows = lines.select(F.explode(F.split(body, r"\r?\n")).alias("l")).filter("trim(l) <> '' and l not like 'First Name%'")
    cols = "`First Name` string, `Last Name` string, URL string, `Email Address` string, Company string, Position string, `Connected On` string"
    return rows.select(F.from_csv("l", cols).alias("r")).select("r.*")


def positions_csv(spark: SparkSession, path: str) -> DataFrame:
    """S11; a missing required column is an error."""
    return dated_csv(spark, path, ["Company Name", "Title", "Started On"], "Started On", "Finished On")


def education_csv(spark: SparkSession, path: str) -> DataFrame:
    return dated_csv(spark, path, ["School Name", "Start Date"], "Start Date", "End Date")


def dated_csv(spark: SparkSession, path: str, required: list[str], start: str, end: str) -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    x = x.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in x.columns})
    if missing := [c for c in required if c not in x.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return x.withColumns({c: partial_date(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in (start, end) if c in x.columns})


def examples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training examples; blank and broken lines and empty examples are left out."""
    x = spark.read.schema("conversation string, messages array<struct<role:string,content:string>>").json(path)
    return x.filter("size(messages) > 0")


def folder_scan(spark: SparkSession, path: str, patterns: dict[str, list[str]]) -> DataFrame:
    """Files and megabytes of each source; a file under two patterns counts twice."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    glob = lambda p: name.rlike("^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$")
    hits = F.array_compact(F.flatten(F.array(*[F.array(*[F.when(glob(p), F.lit(s)) for p in ps]) for s, ps in patterns.items()])))
    c = f.select(F.explode(hits).alias("source"), "length").groupBy("source").agg(F.count("*").alias("files"), F.bround(F.sum("length") / 1048576, 2).alias("mb"))
    return spark.createDataFrame([(s,) for s in patterns], "source string").join(c, "source", "left").fillna({"files": 0, "mb": 0.0})


def lookup_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object as (key, value, ord)."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e")).select("e.key", "e.value", "ord")


def conversation_folders(spark: SparkSession, path: str) -> DataFrame:
    """S17."""
    return _files(spark, path, "*.html").select(F.element_at(F.split("path", "/"), -2).alias("conversation")).distinct()


# --- sinks


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1, K2: a line per row, null fields left out."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def upsert_parquet(spark: SparkSession, old: DataFrame | None, new: DataFrame, key: str, path: str) -> DataFrame:
    """K3: the newest row of each key, written to a path of its own (not the one `old` is read from)."""
    x = new.withColumn("__v", F.lit(1)) if old is None else old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__v"))
    x.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__v").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """K4."""
    df.write.mode("append").parquet(path)
