"""Readers, stores with marks, providers that fail, doubts, and limits of a run."""

import json
import zipfile

from pyspark.sql import functions as F

from skein.config import Limits
from skein.operators import labels, places, providers, similarity
from skein.sinks.tables import Versions
from skein.sources import feeds, records
from skein.storage import Stage


def test_limits():
    got = Limits.from_environment({"SKEIN_MOST_FINAL": "50", "SKEIN_PROVIDER_ENABLED": "False", "SKEIN_MOST_DOUBTS": "many",
            "SKEIN_LOOK_BACK_HOURS": " ", "SKEIN_PROVIDER_BATCH": "-1"})
    assert got == Limits(most_final=50, provider_enabled=False) and Limits.from_environment({}) == Limits()


def test_file_lists_and_mentions(spark, tmp_path):
    line = lambda ts, kind: f"1 a http://x/{ts}.{kind}.csv.zip\n"
    (tmp_path / "en.txt").write_text("".join(line("20240101000000", k) for k in ("export", "mentions", "gkg"))
        + line("20240101001500", "export") + "noise\n")
    (tmp_path / "tr.txt").write_text("".join(line("20240101003000", k) for k in ("gkg", "export", "mentions")))
    got = feeds.read_manifests(spark, {"own": str(tmp_path / "en.txt"), "other": str(tmp_path / "tr.txt"),
            "gone": str(tmp_path / "no.txt"), "off": None}).collect()
    assert sorted((r.feed, r.ts) for r in got) == [("other", "20240101003000"), ("own", "20240101000000")]
    assert feeds.read_manifests(spark, {"gone": str(tmp_path / "no.txt")}).collect() == []
    row = lambda *at: "\t".join(dict(at).get(i, "") for i in range(16))
    (tmp_path / "m.csv").write_text("\n".join([row((0, "7"), (5, " http://a "), (11, "80"), (13, "-1.5")), row((0, "7"), (11, "x")),
                row((5, "no event")), "7\tshort"]))
    got = feeds.read_mentions(spark, str(tmp_path / "m.csv")).orderBy("seq").collect()
    assert [(r.event_id, r.identifier, r.confidence, r.tone) for r in got] == [("7", "http://a", 80.0, -1.5), ("7", None, None, None)]


def test_unreadable_archives_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.csv", "one\ntwo\n")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    told = records.read_zipped(spark, str(tmp_path), errors=True).collect()
    assert sorted(r.line for r in told if r.error is None) == ["one",
        "two"] and {r.path.rsplit("/", 1)[1] for r in told if r.error} == {"bad.zip", "empty.zip"}
    assert records.read_zipped(spark, str(tmp_path)).count() == 2


def test_feeds_of_news(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, feed string")
    known = spark.createDataFrame([("x", "naval", "Sea", "Crete")], "feed string, feed_domain string, feed_label string, hint string")
    assert sorted((r.id, r.feed_domain, r.hint) for r in records.with_feeds(items, known).collect()) == [(1, "naval", "Crete"),
        (2, None, None), (3, None, None)]


def test_marks_count_with_their_version_and_titles_are_purged(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    assert store.marks() == {} and labels.purge(store) == [(0, 0)]
    rows = spark.createDataFrame([(1, "Use conventional military force in X"), (2, "Fleet leaves"), (3, None)], "id int, title string")
    store.replace(rows, {"own": "20240101", "other": None})
    assert store.marks() == {"own": "20240101", "other": None} and store.read().count() == 3
    assert labels.purge(store) == [(1, 2)] and sorted(r.id for r in store.read().collect()) == [2, 3] and store.marks() == {}
    assert labels.purge(store) == [(0, 2)]


EVENTS = "id long, title string, category string, country string, score long"


def events(spark, n=40):
    return spark.createDataFrame([(i, f"t{i}", "military", "US", i) for i in range(n)], EVENTS)


def test_a_provider_that_fails_leaves_all_as_it_is(spark, tmp_path):
    def down(rows):
        raise providers.Unavailable("down")

    def broken(rows):
        return "no json at all ["

    for ask in (down, broken):
        out, known = providers.filtered_by(events(spark), ask, ("military",), Stage(spark, "t"), tries=2, pause=lambda n: 0.0)
        assert sorted((r.id, r.category, r.country, r.title_shown) for r in out.collect()) == [(i, "military", "US", f"t{i}")
            for i in range(40)] and known.count() == 40


def test_a_provider_is_asked_again_in_batches_and_remembered(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(rows):
        ids = [r["id"] for r in rows]
        seen = log / str(min(ids))
        if not seen.exists():  # the first time of every batch
            seen.write_text(json.dumps(ids))
            raise providers.Unavailable("busy")
        return [{"id": i, "keep": i % 2 == 0, "country": "fr", "category": 5, "fr": f"f{i}"} for i in ids
            if i % 10] + [{"id": 99999, "keep": False}, {"no": "id"}, "x"]

    stage = Stage(spark, "t")
    out, known = providers.filtered_by(events(spark), ask, ("military",), stage, batch=7, limit=30, pause=lambda n: 0.0)
    got = {r.id: (r.country, r.title_shown) for r in out.collect()}
    asked = {i for f in log.iterdir() for i in json.loads(f.read_text())}
    assert asked == set(range(10, 40)) and all(len(json.loads(f.read_text())) <= 7 for f in log.iterdir())  # the best 30
    assert set(got) == {i for i in range(40) if i < 10 or i % 10 == 0 or i % 2 == 0}
    assert got[12] == ("FR", "f12") and got[20] == ("US", "t20") and got[3] == ("US", "t3")
    again, held = providers.filtered_by(events(spark).where("id <> 12"), lambda rows: [{"id": r["id"], "keep": False} for r in rows],
        ("military",), Stage(spark, "t2"), cached=known, pause=lambda n: 0.0)
    assert {r.id for r in again.collect()} == {i for i in got if i >= 10 and i != 12} and held.count() == 39


def test_many_doubts_are_not_asked(spark):
    items = lambda n: places.doubtful(spark.createDataFrame([(i, None, "Iran", 30) for i in range(n)],
            "id int, place string, hint string, confidence int"))
    answers = spark.createDataFrame([(i, "Oman", 71) for i in range(200)], "id int, location string, confidence int")
    assert {(r["where"], r.confidence, r.hint_only) for r in places.answered(items(100), answers).collect()} == {("Oman", 51, False)}
    assert {(r["where"], r.confidence, r.hint_only) for r in places.answered(items(101), answers).collect()} == {("Iran", 30, True)}


def test_similar_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = {i: sorted({rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))}) for i in range(120)}
    rows = spark.createDataFrame(list(sets.items()), "id int, words array<string>")
    for measure in ("overlap", "jaccard"):
        for least in (0.2, 0.5, 0.75):
            want = set()
            for a in sets:
                for b in sets:
                    if a < b:
                        x, y = set(sets[a]), set(sets[b])
                        value = len(x & y) / (max(len(x), len(y)) if measure == "overlap" else len(x | y))
                        if value > least:
                            want.add((a, b, round(value, 9)))
            got = {(r.a, r.b, round(r.similarity, 9)) for r in similarity.similar_pairs(rows, "words", least, measure).collect()}
            assert got == want


def test_broken_json_against_a_plain_automaton(spark):
    import random

    from skein.functions.text import balanced_object

    def plain(text):
        start, depth, inside, escaped = text.find("{"), 0, False, False
        if start < 0:
            return None
        for i in range(start, len(text)):
            c = text[i]
            if inside:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    inside = False
            elif c == '"':
                inside = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    return text[start : i + 1]
        return None

    rng = random.Random(5)
    texts = ["".join(rng.choice('{}"\\a \n') for _ in range(rng.randrange(40))).strip() for _ in range(600)] + ['{"a": "' + "x" * 100_000
        + '\\\\"} tail }']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i",
        balanced_object(F.col("t")).alias("o"))
    assert {r.i: r.o for r in rows.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_launches_and_events_of_three_pages(spark, tmp_path):
    from skein.operators import hazards

    launch = {"id": "1", "name": None, "net": "2024-01-01", "status": {"id": 4, "abbrev": "Fail", "name": "Failure"},
        "pad": {"latitude": "x", "longitude": "-80.5", "country": {"name": "US"}}, "failreason": "engine"}
    (tmp_path / "up.json").write_text(json.dumps({"results": [launch, {"id": "2"}]}))
    (tmp_path / "ev.json").write_text(json.dumps({"results": [
                    {"id": "9", "name": "", "type": {"name": "Docking"}, "image": {"image_url": "i"}}]}))
    got = hazards.launches(records.read_launches(spark, str(tmp_path / "up.json")).orderBy("ord")).collect()
    assert [(r.id, r.name, r.status_color, r.status_text, r.lat, r.lon, r.pad_country, r.failure, r.window_end) for r in got] == [
        ("1", "Unknown Mission", "#ff2244", "Failure", 0.0, -80.5, "US", "engine", ""),
            ("2", "Unknown Mission", "#4a6a7a", "", 0.0, 0.0, "", "", ""),
    ]
    event = hazards.launch_events(records.read_launch_events(spark, str(tmp_path / "ev.json"))).first()
    assert (event.id, event.name, event.date, event.type, event.image, event.webcast_live) == ("9", "Unknown Event", None, "Docking", "i",
        False)


def test_a_feed_that_is_out_is_left_out_for_the_run(spark, tmp_path):
    from skein.operators import curation

    (tmp_path / "a.txt").write_text("x\n")
    feed = feeds.Optional(spark, most=2)
    read = lambda s, p: s.read.text(p)
    there, gone = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    assert feed.read(gone, read) is None and not feed.out and feed.read(there, read).count() == 1
    assert feed.read(gone, read) is None and feed.read(gone, read) is None and feed.out and feed.read(there,
        read) is None and feeds.Optional(spark).read(None, read) is None
    rows = spark.createDataFrame([("1", "http://y")], "id string, url string")
    mentions = spark.createDataFrame([("1", 3, "http://x")], "event_id string, mention_count long, best_identifier string")
    one = curation.joined(rows, mentions, None).first()
    assert (one.address, one.mention_count, one.themes, one.extras) == ("http://x", 3, None, None)


def test_geocoder_answers_are_remembered_without_a_place_too(spark):
    def ask(rows):
        said = {"kyiv": [{"class": "place", "type": "city", "importance": 0.2, "lat": "1", "lon": "1"},
                {"class": "place", "type": "city", "importance": 0.7, "lat": "50.4", "lon": "30.5"}], "nowhere": []}
        if rows[0]["id"] == "down":
            raise providers.Unavailable("busy")
        return [{"id": r["id"], "found": json.dumps(said[r["id"]])} for r in rows]

    names = spark.createDataFrame([("Kyiv",), (" kyiv ",), ("Nowhere",), ("down",), ("",), (None,)], "asked string")
    known = places.geocoded(names, ask, Stage(spark, "g"), tries=1)
    assert sorted(map(tuple, known.collect())) == [("kyiv", 50.4, 30.5), ("nowhere", None, None)]

    def never(rows):
        assert [r["id"] for r in rows] == ["down"]
        return [{"id": "down", "found": json.dumps([{"class": "aeroway", "lat": "2", "lon": "3"}])}]

    again = places.geocoded(names, never, Stage(spark, "g2"), cached=known)
    assert sorted(map(tuple, again.collect())) == [("down", 2.0, 3.0), ("kyiv", 50.4, 30.5), ("nowhere", None, None)]


def test_segments_of_a_stream(spark, tmp_path):
    from skein.streaming import reports

    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = spark.createDataFrame([(1, at(m)) for m in (0, 5, 14, 30, 31)] + [(2, at(0))] + [(9, "2024-01-03 00:00:00")],
        "entity int, t string").select("entity", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reports.segments(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("append").format("memory").queryName("segments").option("checkpointLocation",
        str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.entity, r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.n) for r in spark.table("segments").collect())
    assert got == [(1, "00:00", "00:24", 3), (1, "00:30", "00:41", 2), (2, "00:00", "00:10", 1)]


def test_places_of_odd_titles(spark):
    gazetteer = spark.createDataFrame(
        [("red sea", 0, 0, 1.0, 1.0), ("pentagon", 0, 1, 2.0, 2.0), ("oman", 1, 0, 3.0, 3.0), ("oman", 2, 0, 4.0, 4.0), ("sumy", 2, 1, 5.0, 5.0), ("são paulo", 2, 2, 6.0, 6.0)],
        "name string, kind int, ord int, lat double, lon double",
    )
    mentions = spark.createDataFrame([("omani", "oman", 0), ("atlantis", "atlantis", 1)], "said string, canonical string, ord int")
    titles = [(1, None), (2, ""), (3, "Pentagon confirms strike"), (4, "Ships at the Pentagon"), (5, "Fire in Sumy Region"), (6, "Omani fleet sails"), (7, "Near Atlantis"), (8, "raid in São Paulo"),
              (9, "predator sea"), (10, "in Oman near the Red Sea"), (10, "in Oman near the Red Sea"), (11, "In the Monday"), (12, "strikes Sumy's Airport"), (13, "Oman launches"), (14, "near Sumy " * 3000)]
    rows = spark.createDataFrame(titles, "key int, title string")
    got = {r.key: (r.place, r.stage, r.lat) for r in places.places_of_titles(rows, gazetteer, mentions).collect()}
    assert got == {
        4: ("Pentagon", 2, 2.0), 5: ("Sumy Region", 2, 5.0), 6: ("oman", 4, 3.0), 8: ("São Paulo", 2, 6.0), 10: ("red sea", 1, 1.0), 12: ("Sumy's Airport", 5, None), 13: ("oman", 3, 3.0), 14: ("Sumy", 2, 5.0),
    }
    assert places.places_of_titles(rows.limit(0), gazetteer, mentions).collect() == []


def test_summaries_of_answers(spark):
    rows = spark.createDataFrame([(i, f"title {i}" if i else None, None, "FR" if i % 2 else None, i, 1.0, 1.0) for i in range(4)], "id int, title string, category string, country string, score int, lat double, lon double")
    plain = providers.summaries(rows).first()
    assert (plain.id, plain.event_count, plain.country, plain.summary) == ("sig_2_2", 4, "FR", "title 3") and [p.point for p in plain.key_points] == ["title 3", "title 2", "title 1"]
    answers = lambda text: spark.createDataFrame([(2, 2, text)], "cell_lat int, cell_lon int, text string")
    told = providers.summaries(rows, answers('```json\n{"summary": " s ", "key_points": [{"point": "p"}]}\n```')).first()
    assert (told.location_name, told.summary, [tuple(p) for p in told.key_points]) == ("FR", "s", [("p", "conflict")])
    assert providers.summaries(rows, answers("cut off {")).collect() == []
