import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import aggregates
from hearthlog.sources import exports as X
from hearthlog.streaming import twins


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def section(name, body, stamp):
    return f'<section class="_a6-g"><h2 class="_a6-h">{name}</h2><div class="_a6-p"><div>{body}</div></div><footer class="_a6-o"><div class="_a72d">{stamp}</div></footer></section>'


def test_chat_html(spark, tmp_path):
    page = section("Ann B", "<div>hello &amp; hi</div><div>hello &amp; hi</div><div>IP Address: 1.2.3.4</div><ul><li>❤ Bo</li></ul>", "Jun 18, 2015 9:35:16 pm") + section("Bo", "later", "no date") + section("Bo", "", "Jun 18, 2015 9:36:16 pm")
    put(tmp_path / "inbox/ann_123/message_1.html", f"<html><body>{page}</body></html>")
    (r,) = X.chat_html(spark, str(tmp_path)).collect()
    assert (r["sender_name"], r["text"], r["conversation"], r["date"]) == ("Ann B", "hello & hi", "ann_123", datetime(2015, 6, 18, 21, 35, 16))
    assert [r["conversation"] for r in X.conversation_folders(spark, str(tmp_path)).collect()] == ["ann_123"]
    assert sorted((r["name"], r["since"]) for r in X.friends_html(spark, str(tmp_path)).collect()) == [("Ann B", "2015-06-18T21:35:16"), ("Bo", "2015-06-18T21:36:16"), ("Bo", "no date")]
    files = spark.createDataFrame([("file:/a/b/x.html",), ("file:/a/b/c/y.html",)], "path string")
    assert sorted(tuple(r) for r in aggregates.files_by_folder(files).collect()) == [("a", 2, 0), ("a/b", 2, 1), ("a/b/c", 1, 1)]


def test_json_sources(spark, tmp_path):
    m = {"date": "2020-01-01T00:00:00", "text": "hi", "conversation": "c_1"}
    for name, data in (("a", [m, m]), ("b", {"chunks": [m]}), ("c", {"messages": [m, m, m]})):
        assert X.messages_json(spark, put(tmp_path / f"{name}.json", json.dumps(data))).filter("type = 'text' and language = 'en' and sender_name = ''").count() == {"a": 2, "b": 1, "c": 3}[name]
    play = {"ts": "2020", "ms_played": 30001, "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A"}
    (p,) = X.plays_json(spark, put(tmp_path / "p.json", json.dumps([play]))).collect()
    assert (p["album"], p["uri"]) == ("Unknown Album", "T — A")
    seg = {"semanticSegments": [{"startTime": "2020-01-01T00:00:00Z", "visit": {"topCandidate": {"placeLocation": {"latLng": "48.1°, 2.3°"}}}}, {"startTime": "2020-01-02T00:00:00Z", "activity": {"start": {"latLng": "x"}, "topCandidate": {"type": "IN_BUS"}}}], "locations": [{"latitudeE7": 481000000, "longitudeE7": 23000000, "timestamp": "2020-01-03T00:00:00Z"}]}
    got = {str(r["ts"])[:10]: (r["lat"], r["lng"], r["mode"]) for r in X.locations_json(spark, put(tmp_path / "l.json", json.dumps(seg))).collect()}
    assert got == {"2020-01-01": (48.1, 2.3, None), "2020-01-02": (None, None, "IN_BUS"), "2020-01-03": (48.1, 2.3, None)}
    assert {r["key"]: r["value"] for r in X.lookup_json(spark, put(tmp_path / "k.json", '{"1": "one", "2": "two"}')).collect()} == {"1": "one", "2": "two"}
    lines = '{"conversation": "a", "messages": [{"role": "user", "content": "x"}]}\n\nbroken\n{"conversation": "b", "messages": []}\n'
    assert [r["conversation"] for r in X.examples_jsonl(spark, put(tmp_path / "e.jsonl", lines)).collect()] == ["a"]


def test_csv_sources(spark, tmp_path):
    g = X.game_sessions(spark, put(tmp_path / "g.csv", "appid,start_at,end_at\n 1 ,2020-01-01 00:00:00,2020-01-01 01:00:00\n2,2020-01-02 00:00:00,2020-01-01 00:00:00\n3,,\n4,x,y\n"))
    assert sorted((r["appid"], r["duration_s"]) for r in g.collect()) == [("1", 3600), ("2", 0)]
    a = X.activities_csv(spark, put(tmp_path / "a.csv", 'Activity ID,Activity Name,Activity Type,Activity Date,Elapsed Time,Distance,Calories\n7,Run,Run,"Jun 3, 2018, 7:00:34 PM",12.9,5.5,\n8,Old,Ride,never,,x,1\n'))
    assert sorted((r["id"], str(r["date"]), r["elapsed_s"], r["distance"], r["calories"]) for r in a.collect()) == [("7", "2018-06-03 19:00:34", 12, 5.5, 0.0), ("8", "1970-01-01 00:00:00", 0, 0.0, 1.0)]
    c = X.connections_csv(spark, put(tmp_path / "c.csv", "﻿Notes:\nsome note\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nAnn,B,u,e,Acme,Dev,03 Jan 2026\n"))
    assert [(r["First Name"], r["Company"]) for r in c.collect()] == [("Ann", "Acme")]
    p = X.positions_csv(spark, put(tmp_path / "p.csv", "﻿Company Name,Title,Started On,Finished On\nAcme,Dev,Sep 2020,Present\nOld,Dev,2019,soon\n"))
    assert sorted((r["Company Name"], r["Started On"], r["Finished On"]) for r in p.collect()) == [("Acme", "2020-09-01", ""), ("Old", "2019-01-01", "soon")]
    with pytest.raises(ValueError, match="Title"):
        X.positions_csv(spark, put(tmp_path / "q.csv", "Company Name,Started On\nA,2019\n"))


def test_tracks_and_calendar(spark, tmp_path):
    put(tmp_path / "t/a.gpx", '<gpx><trkpt lat="1.5" lon="-2.5"/><trkpt lat="9" lon="9"/></gpx>')
    put(tmp_path / "t/b.tcx.gz", gzip.compress(b"<T><LatitudeDegrees>3.5</LatitudeDegrees><LongitudeDegrees>4.5</LongitudeDegrees></T>"))
    assert sorted((r["lat"], r["lng"]) for r in X.gps_start(spark, str(tmp_path / "t")).collect()) == [(1.5, -2.5), (3.5, 4.5)]
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:w\r\nSUMMARY:Weekly\r\n  call\r\nDTSTART:20200101T100000Z\r\nDTEND:20200101T113000Z\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:d\r\nDTSTART;VALUE=DATE:20200202\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    put(tmp_path / "c/x.ics", ics)
    got = sorted((r["id"], r["summary"], str(r["start"]), str(r["end"])) for r in X.calendar_ics(spark, str(tmp_path / "c")).collect())
    assert got[0] == ("evt_d_20200202T000000", None, "2020-02-02 00:00:00", "2020-02-02 01:00:00")
    assert [g[2] for g in got[1:]] == ["2020-01-01 10:00:00", "2020-01-08 10:00:00", "2020-01-15 10:00:00"] and got[1][1] == "Weekly call" and got[1][3] == "2020-01-01 11:30:00"


def test_folder_scan_and_sinks(spark, tmp_path):
    put(tmp_path / "s/Records.json", "{}")
    put(tmp_path / "s/x.csv", "a")
    assert sorted((r["source"], r["files"]) for r in X.folder_scan(spark, str(tmp_path / "s"), {"maps": ["Records.json", "*.json"], "games": ["*.csv"], "none": ["*.zip"]}).collect()) == [("games", 1), ("maps", 2), ("none", 0)]
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    X.upsert_parquet(spark, None, a, "id", str(tmp_path / "v1"))
    v2 = X.upsert_parquet(spark, spark.read.parquet(str(tmp_path / "v1")), spark.createDataFrame([(2, "c"), (3, "d")], "id int, t string"), "id", str(tmp_path / "v2"))
    assert sorted(tuple(r) for r in v2.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    X.append_parquet(a, str(tmp_path / "v2"))
    X.write_json(a.withColumn("n", F.lit(None).cast("string")), str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "v2")).count() == 5 and spark.read.json(str(tmp_path / "j")).columns == ["id", "t"]


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "user_id", "event_id")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("sessions", twins.sessions(read(), "user_id", "ts", late="1000 days"), e.groupBy("user_id", F.session_window("ts", "8 hours")).count().count()), ("days", twins.counters(read(), "ts", "user_id", late="1000 days"), e.groupBy("user_id", F.window("ts", "1 day")).count().count())):
        q = df.writeStream.outputMode("complete" if name == "days" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        n = spark.table(name).count()
        assert n == want if name == "days" else 0 <= n <= want
    seen = []
    twins.merge_into(twins.idempotent(read(), "ts", ["event_id"], "1000 days"), lambda df, _: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == e.select("event_id").distinct().count()


def test_recurring_dates():
    from datetime import datetime as D

    from hearthlog.sources.recurrence import occurrences

    end = D(2030, 12, 31)
    days = lambda start, rule, n=99: [f"{d:%Y-%m-%d}" for _, d in zip(range(n), occurrences(start, rule, end))]
    assert days(D(2024, 1, 31, 9), "FREQ=MONTHLY;COUNT=4") == ["2024-01-31", "2024-03-31", "2024-05-31", "2024-07-31"]
    assert days(D(2024, 1, 1), "FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4") == ["2024-01-01", "2024-01-03", "2024-01-08", "2024-01-10"]
    assert days(D(2024, 1, 3), "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE;COUNT=3") == ["2024-01-03", "2024-01-15", "2024-01-17"]
    assert days(D(2024, 1, 9), "FREQ=MONTHLY;BYDAY=2TU;COUNT=3") == ["2024-01-09", "2024-02-13", "2024-03-12"]
    assert days(D(2024, 1, 26), "FREQ=MONTHLY;BYDAY=-1FR;UNTIL=20240401") == ["2024-01-26", "2024-02-23", "2024-03-29"]
    assert days(D(2024, 1, 31), "FREQ=MONTHLY;BYMONTHDAY=-1;COUNT=3") == ["2024-01-31", "2024-02-29", "2024-03-31"]
    assert days(D(2024, 1, 31), "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=2") == ["2024-01-31", "2024-02-29"]
    assert days(D(2024, 2, 29), "FREQ=YEARLY;COUNT=2") == ["2024-02-29", "2028-02-29"]
    assert days(D(2024, 11, 28), "FREQ=YEARLY;BYMONTH=11;BYDAY=4TH;COUNT=2") == ["2024-11-28", "2025-11-27"]
    assert days(D(2024, 1, 1), "FREQ=DAILY;INTERVAL=10;UNTIL=20240122T000000Z") == ["2024-01-01", "2024-01-11", "2024-01-21"]
    assert days(D(2024, 1, 1), None) == ["2024-01-01"] and days(D(2030, 12, 1), "FREQ=MONTHLY") == ["2030-12-01"]


def test_calendar_exceptions_and_zones(spark, tmp_path):
    event = lambda *lines: "BEGIN:VEVENT\r\n" + "\r\n".join(lines) + "\r\nEND:VEVENT\r\n"
    put(tmp_path / "z/x.ics", "BEGIN:VCALENDAR\r\n" + event("UID:a", "DTSTART;TZID=Europe/Paris:20240325T090000", "DTEND;TZID=Europe/Paris:20240325T100000", "RRULE:FREQ=WEEKLY;COUNT=4", "EXDATE;TZID=Europe/Paris:20240408T090000")
        + event("UID:a", "RECURRENCE-ID;TZID=Europe/Paris:20240401T090000", "DTSTART;TZID=Europe/Paris:20240402T110000", "SUMMARY:moved") + "END:VCALENDAR\r\n")
    got = sorted((r["id"], str(r["start"]), r["summary"]) for r in X.calendar_ics(spark, str(tmp_path / "z")).collect())
    assert got == [("evt_a_20240325T090000", "2024-03-25 08:00:00", None), ("evt_a_20240402T110000", "2024-04-02 09:00:00", "moved"), ("evt_a_20240415T090000", "2024-04-15 07:00:00", None)]
