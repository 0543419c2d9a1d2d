"""Sinks, views, readers and streams against what plain code gives."""

import json
import zipfile

from pyspark.sql import functions as F

from skein import api
from skein.operators import curation, fleets, hazards
from skein.sinks import tables
from skein.sources import records
from skein.streaming import reports

FOLDER = "/root/testdata/sf0.001"


def test_days_are_replaced_and_versions_guarded(spark, tmp_path):
    path = str(tmp_path / "days")
    tables.write_days(spark.createDataFrame([(1, "a"), (2, "b")], "x int, day string"), path)
    tables.write_days(spark.createDataFrame([(3, "b"), (4, "b")], "x int, day string"), path)
    assert [(r.day, r.n) for r in tables.days(spark, path).collect()] == [("b", 2), ("a", 1)]
    store = tables.Versions(spark, str(tmp_path / "store"))
    rows = lambda n: spark.range(n).select("id", F.lit("a").alias("v"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"))
    assert store.read() is None and not store.save_more(rows(0)) and store.save_more(rows(3)) and not store.save_more(
        rows(2)) and store.save_more(rows(4))
    at = lambda t: F.lit(t).cast("timestamp")
    assert store.restore("t", at("2024-01-01 01:00:00"), 2).count() == 4 and store.restore("t", at("2024-01-02 00:00:00"), 2) is None
    patched = store.patch(spark.createDataFrame([(1, "z"), (9, "y")], "id long, v string"), "id")
    assert {r.id: r.v for r in patched.collect()} == {0: "a", 1: "z", 2: "a", 3: "a"}
    log = str(tmp_path / "log")
    tables.append_lines(rows(2), log)
    tables.append_lines(rows(3), log)
    assert spark.read.json(log).count() == 5
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", 'a"'), (2, 0, "user", None)],
        "conv_id int, turn int, role string, text string")
    tables.chat_lines(turns, str(tmp_path / "chat"), "be brief")
    lines = sorted([json.loads(r.value)["messages"] for r in spark.read.text(str(tmp_path / "chat")).collect()], key=len)
    assert lines[1] == [{"role": "system", "content": "be brief"}, {"role": "user", "content": 'a"'},
        {"role": "assistant", "content": "b"}] and len(lines[0]) == 2


def test_views(spark):
    events = spark.range(1500).select("id", (F.col("id") % 7).alias("score"))
    found = {"events": events, "clusters": spark.createDataFrame([(1, 2, 3)], "n long, cell_lat int, cell_lon int")}
    assert [api.page_size(x) for x in (None, "5", "x", -1, 0.5, 5000, float("nan"))] == [200, 5, 200, 200, 200, 1000, 200]
    assert api.view("events", found).count() == 800 and api.view("events", found, 3).collect()[0].score == 6 and api.view("tip",
        found) is None
    assert set(api.bundle(found)) == {"events", "osint", "signals"} and set(api.bundle(found, "signals, tip")) == {"signals"}
    row = api.envelope("events", api.view("events", found, 2), F.lit("now")).first()
    assert (row.version, row["count"], len(json.loads(row.data))) == (1, 2, 2)
    assert {r.table: r.n for r in api.health(found, spark).collect()} == {"events": 1500, "clusters": 1}
    days = spark.createDataFrame([(f"d{i:02d}", None, "HIGH") for i in range(40)], "day string, category string, severity string")
    assert [r.day for r in api.history(days, 2).collect()] == ["d39", "d38"]
    t = lambda x: F.lit(x).cast("timestamp")
    shown = spark.range(1).select(*(api.status(t(x), t("2024-01-02 00:00:00"), 2).alias(str(i)) for i,
            x in enumerate(("2024-01-01 23:00:00", "2024-01-01 00:00:00", None)))).first()
    assert tuple(shown) == ("fresh", "stale", "missing")
    assert [api.source_status(*x) for x in ((False, False, False, 0), (True, True, False, 0), (True, False, False, 0),
            (True, False, True, 3), (True, False, True, 0))] == ["not_configured", "refreshing", "ok", "degraded", "error"]
    assert api.launch_guard(False, 200, None) and not api.launch_guard(False, 500, 1.0) and not api.launch_guard(True, 500, 9.0)
    rows = spark.createDataFrame([("https://cdn.jetphotos.com/a", b"x"), ("http://cdn.jetphotos.com/a", b"x"),
            ("https://evil.net/cdn.jetphotos.com", b"x"), (None, b"x")], "url string, content binary")
    assert [(r.url, r.data) for r in api.pictures(rows).collect()] == [("https://cdn.jetphotos.com/a", "eA==")]


def test_record_readers(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    quake = {"features": [{"id": "q", "properties": {"mag": 6.5, "alert": "red", "time": 0}, "geometry": {"coordinates": [1.0, 2.0, 3.0]}},
            {"id": None, "properties": {}, "geometry": None}]}
    rows = hazards.quakes(records.read_quakes(spark, put("q.json", quake))).collect()
    assert (rows[0].color, rows[0].lat, rows[0].depth, rows[1].mag, rows[1].lat) == ("#ff2244", 2.0, 3.0, 0.0, 0.0)
    launch = {"results": [{"id": "l", "status": {"id": 3}, "rocket": {"configuration": {"full_name": "", "name": "R"}},
                "pad": {"latitude": "1.5", "longitude": "x"}}]}
    row = hazards.launches(records.read_launches(spark, put("l.json", launch))).first()
    assert (row.name, row.status_color, row.rocket, row.lat, row.lon, row.provider) == ("Unknown Mission", "#00d4ff", "R", 1.5, 0.0,
        "Unknown")
    objects = [{"NORAD_CAT_ID": str(i), "DECAY_EPOCH": f"2024-01-0{i} 00:00:00"} for i in (3, 1, 2, 5)]
    assert [r.NORAD_CAT_ID for r in records.read_objects(spark, put("o.json", objects), "2024-01-02", "2024-01-04").collect()] == ["2", "3"]
    planes = {"ac": [{"hex": "~ADF7C8", "flight": " RCH1 ", "lat": 1.0, "lon": 2.0, "alt_baro": "30000", "gs": 400.4},
            {"hex": "adf7c8", "lat": 1.0, "lon": 2.0, "alt_baro": "ground"}]}
    got = fleets.from_objects(records.read_aircraft(spark, put("a.json", planes))).collect()
    assert (got[0].id, got[0].callsign, got[0].country, got[0].alt_ft, got[0].speed, got[1].reject) == ("adf7c8", "RCH1", "USA", 30000,
        400, "on_ground")
    state = {"states": [["adf7c8", None, None, None, None, 2.5, 1.5, 1000, False, 100, 90]]}
    row = fleets.from_states(records.read_states(spark, put("s.json", state))).first()
    assert (row.callsign, row.lat, row.alt_ft, row.speed, row.reject) == ("ADF7C8", 1.5, 3281, 194, None)
    vessels = {"entries": [{"id": None, "type": "GAP", "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T01:00:00Z",
                "position": {"lat": 1.0, "lon": 2.0}, "vessel": {"ssvid": "9"}}]}
    row = hazards.vessel_anomalies(records.read_vessel_events(spark, put("v.json", vessels))).first()
    assert (row.id, row.kind, row.minutes, row.vessel_id) == ("gfw-dark_shipping-0", "dark_shipping", 60, "9")
    lines = [{"MessageType": "ShipStaticData", "MetaData": {"MMSI": 338}, "Message": {"ShipStaticData": {"Name": "USS X", "Type": 35}}},
        {"MessageType": "PositionReport", "MetaData": {"MMSI": 338, "latitude": 5.0},
            "Message": {"PositionReport": {"Longitude": 6.0, "TrueHeading": 511}}}, {"MessageType": "Other", "MetaData": {"MMSI": 1}}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    got = records.ship_messages(spark.read.schema(records.SHIPS).json(str(tmp_path / "m.json"))).collect()
    assert [(r.kind, r.name, r.lat, r.lon, r.heading) for r in got] == [("static", "USS X", None, None, None),
        ("position", None, 5.0, 6.0, None)]


def test_zipped_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fields = [""] * 27
    fields[4], fields[7], fields[8], fields[13], fields[15], fields[
        26] = "http://x", "OLD", "A;; B", "ORG", "-2.5,1", "<PAGE_TITLE>T here</PAGE_TITLE>"
    last = list(fields)
    last[8] = ""
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("a.csv", "\t".join(fields) + "\nshort\trow\n" + "\t".join(last) + "\n")
    (tmp_path / "in" / "bad.zip").write_bytes(b"no zip")
    lines = records.read_zipped(spark, str(tmp_path / "in"))
    rows = records.documents_of_lines(lines.coalesce(1)).collect()
    assert [(r.address, r.themes, r.organizations, r.tone, r.extras)
        for r in rows] == [("http://x", ["OLD"], ["ORG"], -2.5, fields[26])] and lines.count() == 3
    events = spark.createDataFrame([("1", "http://y"), ("2", "http://z")], "id string, url string")
    mentions = spark.createDataFrame([("1", 3, "http://x")], "event_id string, mention_count long, best_identifier string")
    got = {r.id: (r.address, r.themes) for r in curation.joined(events, mentions, records.documents_of_lines(lines.coalesce(1))).collect()}
    assert got == {"1": ("http://x", ["OLD"]), "2": ("http://z", None)}


def test_look_back_snapshot_of_a_stream(spark, tmp_path):
    folder, store = tmp_path / "in", tables.Versions(spark, str(tmp_path / "store"))
    rows = lambda x: spark.createDataFrame(x, "key string, score int, t string").select("key", "score", F.to_timestamp("t").alias("ts"))
    batches = [[("a", 1, "2024-01-01 00:00:00"), ("b", 5, "2024-01-01 20:00:00")],
        [("a", 3, "2024-01-01 22:00:00"), ("b", 2, "2024-01-01 23:00:00"), ("late", 9, "2023-12-01 00:00:00")],
        [("c", 1, "2024-01-02 21:00:00")]]
    for batch in batches:
        rows(batch).coalesce(1).write.mode("append").parquet(str(folder))
        query = reports.ingest(spark, str(folder), rows(batch).schema, reports.look_back(store, "key"), str(tmp_path / "mark"), files=1)
        assert query.awaitTermination(120)
    assert {(r.key, r.score) for r in store.read().collect()} == {("a", 3), ("c", 1)}


def test_verified_positions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    from skein.plans import fleet_queries

    batch = fleet_queries.messages(spark, FOLDER)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reports.verified_positions(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), idle_ms=None)
    query = stream.writeStream.outputMode("append").format("memory").queryName("ships").option("checkpointLocation",
        str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = fleets.verified_ships(batch).select("number", "ship", "ts_us")
    assert sorted(map(tuple, spark.table("ships").select("number", "ship", "ts_us").collect())) == sorted(map(tuple, want.collect()))


def test_stream_repeats_and_hours(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"2024-01-01 0{i % 3}:00:00", "k") for i in range(30)],
        "entity int, t string, kind string").select("entity", F.to_timestamp("t").alias("ts"), "kind")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("once", reports.without_repeats(read(), ["entity"]), "append"),
        ("hours", reports.hourly(read()), "complete")):
        stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation",
            str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 5 and {r.n for r in spark.table("hours").collect()} == {10}
