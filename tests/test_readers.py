"""Readers with partitions of their own: byte ranges of JSON arrays, file groups with pushed filters."""

import gzip
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthlog.sources import exports, json_ranges
from hearthlog.sources.pages import export_files

from .test_sources import put, section


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- JSON


def odd_objects(seed, n):
    r = random.Random(seed)
    bits = ['"', "\\", '\\"', "{", "}", "[", "]", ",", "é", "\n", "a", '\\\\"', "\\\\\\", " "]
    say = lambda: "".join(r.choices(bits, k=r.randint(0, 12)))
    return [{"ts": f"t{i}", "ms_played": i, say() + "k": {"in": [say(), {"x": [[say()]]}, []]}, "platform": say() * r.randint(1, 3)} for i in range(n)]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_objects_of_ranges(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(json_ranges, "MORE", 5)
    n = 6 if split == 1 else 60
    a, b = odd_objects(1, n), odd_objects(2, 5)
    put(tmp_path / "a.json", json.dumps(a, ensure_ascii=False))
    put(tmp_path / "b.json", "\n [\n" + ",\n".join(json.dumps(x, indent=1) for x in b) + ', 3, "x{", []]\n')
    put(tmp_path / "c.json", json.dumps({"note": "a ] } b", "chunks": a[:4], "more": [1, "{"], "messages": b[:2]}))
    put(tmp_path / "d.json", "")
    put(tmp_path / "e.json", "[]")
    put(tmp_path / "f.json", json.dumps(b)[:-30])
    got: dict = {}
    for r in json_ranges.json_objects(spark, str(tmp_path), split).collect():
        got.setdefault(r["path"][-6:-5], []).append((r["at"], json.loads(r["value"])))
    got = {k: [x for _, x in sorted(v, key=lambda x: x[0])] for k, v in got.items()}
    assert got == {"a": a, "b": b, "c": a[:4] + b[:2], "f": b[:4]}


def test_a_large_file_in_several_tasks(spark, tmp_path):
    rows = [{"ts": f"{i}", "ms_played": i, "platform": 'x"\\' * (i % 50), "master_metadata_track_name": "{" * (i % 7)} for i in range(60_000)]
    path = put(tmp_path / "plays.json", json.dumps(rows))
    got = json_ranges.rows_of(spark, path, exports.PLAY, split=1 << 20)
    want = spark.read.schema(exports.PLAY).option("multiLine", True).json(path)
    assert got.rdd.getNumPartitions() > 1 and got.count() == 60_000
    assert got.exceptAll(want).count() == 0
    tasks = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 1


# --- pages


def test_pages_with_pushed_filters(spark, tmp_path):
    day = lambda d, h: f"Jun {d}, 2015 {h}:35:16 pm"
    for who in ("ann_1", "bo_2", "cy_3"):
        for k in (1, 2):
            put(tmp_path / f"inbox/{who}/message_{k}.html", "".join(section(who, f"{who} {k} {d} &lt;b&gt;", day(d, k)) for d in (3, 9, 27)) + section("x", "no date", "never"))
    whole = export_files(spark, str(tmp_path), "chat", groupBytes=1)
    old = exports.chat_html(spark, str(tmp_path))
    assert sorted((r["folder"], r["ord"], r["sender_name"], str(r["date"]), r["text"]) for r in whole.collect()) == sorted((r["conversation"], r["ord"], r["sender_name"], str(r["date"]), r["text"]) for r in old.collect())
    assert whole.rdd.getNumPartitions() == 6
    some = whole.filter("folder in ('ann_1', 'cy_3') and date >= timestamp_ntz'2015-06-09 13:35:16' and date < timestamp_ntz'2015-06-27 14:00:00' and text like '% 1 %'")
    assert sorted((r["folder"], r["text"], str(r["date"])) for r in some.collect()) == sorted((w, f"{w} 1 {d} <b>", f"2015-06-{d:02d} 13:35:16") for w in ("ann_1", "cy_3") for d in (9, 27))
    assert some.rdd.getNumPartitions() == 4  # two folders' files
    left = plan(some).split("Filter")[1].split("BatchScan")[0]  # what Spark still filters itself
    assert "text" in left and "IN (ann_1" not in left and "2015" not in left
    assert whole.count() == 18
    assert whole.filter("folder = 'ann_1' and folder = 'bo_2'").count() == 0
    friends = export_files(spark, str(tmp_path), "friends").filter("since > timestamp_ntz'2015-06-20 00:00:00'")
    assert {(r["name"], str(r["since"])[:10]) for r in friends.collect()} == {(w, "2015-06-27") for w in ("ann_1", "bo_2", "cy_3")}


def test_tracks_and_calendars(spark, tmp_path):
    put(tmp_path / "t/a.gpx", '<gpx><trkpt lat="48.5" lon="-2.25"></trkpt></gpx>')
    put(tmp_path / "t/b.tcx.gz", gzip.compress(b"<LatitudeDegrees> 1.5</LatitudeDegrees><LongitudeDegrees>2</LongitudeDegrees>"))
    put(tmp_path / "t/c.gpx", "<gpx/>")
    got = export_files(spark, str(tmp_path), "track")
    assert sorted((r["path"][-5:], r["lat"], r["lng"]) for r in got.collect() if r["lat"]) == [("a.gpx", 48.5, -2.25), ("cx.gz", 1.5, 2.0)] and got.count() == 3
    put(tmp_path / "c/x.ics", "BEGIN:VEVENT\nUID:u\nDTSTART:20240105T100000Z\nDTEND:20240105T113000Z\nRRULE:FREQ=WEEKLY;COUNT=4\nSUMMARY:s\nEND:VEVENT\n")
    events = export_files(spark, str(tmp_path), "calendar")
    assert sorted((r["id"], r["start"]) for r in events.filter("start >= timestamp_ntz'2024-01-12 00:00:00'").collect()) == [(f"evt_u_202401{d}T100000", datetime(2024, 1, d, 10)) for d in (12, 19, 26)]
    plain = exports.calendar_ics(spark, str(tmp_path))
    assert sorted((r["id"], str(r["start"]), str(r["end"])) for r in plain.collect()) == sorted((r["id"], str(r["start"]), str(r["end"])) for r in events.collect())
