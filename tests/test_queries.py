"""Every query of the engine against its SQL, and the order-dependent ones against a plain loop."""

import decimal
import math

import duckdb
import pytest

from skein.plans import catalogue, event_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (bool, type(None), str)):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if math.isnan(x) else float(f"{float(x):.9g}")
    return str(x)


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    df = catalogue.queries()[name](spark, FOLDER)
    oracle = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in oracle.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, oracle.fetchall())


def test_greedy_distinct_is_the_loop_over_all_rows(spark):
    from pyspark.sql import functions as F

    from skein.operators.selection import greedy_distinct
    from skein.storage import Stage

    data = [(i, f"t{i * 7 % 40}", f"p{i * 11 % 50}" if i % 9 else None, f"c{i * 13 % 60}" if i % 4 else None, i * 31 % 17)
        for i in range(200)]
    df = spark.createDataFrame(data, "id long, a string, b string, c string, score long")
    got = {r.id for r in greedy_distinct(df, ["a", "b", "c"], [(-F.col("score")).alias("s"), F.col("id").alias("i")],
            Stage(spark, "test")).collect()}
    seen, want = set(), set()
    for i, *keys, score in sorted(data, key=lambda r: (-r[4], r[0])):
        named = [(n, k) for n, k in enumerate(keys) if k is not None]
        if not seen.intersection(named):
            want.add(i)
            seen.update(named)
    assert got == want


def test_distances_over_the_poles_and_the_date_line(spark):
    from skein.functions.geo import haversine
    from skein.operators.spatial import within_km

    places = [(i, (i * 37 % 181) - 90.0, (i * 101 % 361) - 180.0) for i in range(300)] + [(900, 90.0, 0.0), (901, -90.0, 10.0),
        (902, 0.0, 180.0), (903, 0.0, -180.0), (904, None, 1.0)]
    a = spark.createDataFrame(places, "seq long, lat double, lon double")
    b = a.toDF("site", "site_lat", "site_lon")
    for km in (300.0, 4000.0):
        got = {(r.seq, r.site) for r in within_km(a, b, km).select("seq", "site").collect()}
        whole = a.crossJoin(b).where(haversine(a.lat, a.lon, b.site_lat, b.site_lon) <= km)
        assert got == {(r.seq, r.site) for r in whole.select("seq", "site").collect()}


def test_boundaries_of_severity_and_normal_text(spark):
    from pyspark.sql import functions as F

    from skein.functions.geo import severity, tone_color, turn
    from skein.functions.text import has_keyword, normalize

    got = spark.createDataFrame([(-7.0,), (-5.0,), (-2.0,), (0.0,), (0.1,)], "t double").select(severity(F.col("t")),
        tone_color(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("CRITICAL", "#ff2244"), ("SEVERE", "#ff5533"), ("HIGH", "#ffdd55"), ("LOW", "#00d4ff"),
        ("LOW", "#00d4ff")]
    texts = spark.createDataFrame([("Société &amp; War!",), ("software",), (None,)], "x string").select(normalize(F.col("x")).alias("n"))
    assert [tuple(r) for r in texts.select("n", has_keyword(F.col("n"), ["war"])).collect()] == [("societe war", True),
        ("software", False), ("", False)]
    assert spark.range(1).select(turn(F.lit(350.0), F.lit(10.0))).first()[0] == 20.0


def test_empty_tables_give_no_events(spark):
    empty = spark.createDataFrame([],
        "id long, title string, lat double, lon double, tone double, root string, code string, sources long, articles long, mentions long, geo_type long, age_h double, country string")
    assert event_queries.scoring.scored(empty).count() == 0


def test_feeds(spark, tmp_path):
    from skein.sources import feeds

    line = [""] * 61
    line[0], line[56], line[57], line[60], line[34] = "7", "1.5", "2", "http://x", "-3"
    (tmp_path / "e.csv").write_text("\t".join(line) + "\nbroken\n")
    row = feeds.read_events(spark, str(tmp_path / "e.csv")).first()
    assert (row.id, row.lat, row.tone, row.url) == ("7", 1.5, -3.0, "http://x")
    (tmp_path / "m.txt").write_text("".join(f"1 x http://h/2024010100000{b}.{k}.csv.zip\n" for b,
            k in ((0, "export"), (0, "mentions"), (0, "gkg"), (1, "export"))))
    batches = feeds.read_manifest(spark, str(tmp_path / "m.txt"))
    assert [r.ts for r in feeds.pending(batches, None).collect()] == ["20240101000000"]
    xml = spark.createDataFrame(
        [("<rss><item><title><![CDATA[A &amp; B]]></title><link>u</link><source url=\"s\">S</source></item><item><link>v</link></item></rss>",
            )], "xml string")
    assert [(r.title, r.link, r.source_url) for r in feeds.rss_items(xml).collect()] == [("A & B", "u", "s")]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    from skein.streaming import reports

    source = spark.read.parquet(f"{FOLDER}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    rows_ = lambda df: df.select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("kind"),
        (F.col("event_id") % 90).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    stream = rows_(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    query = reports.trails(stream, idle_ms=None).writeStream.outputMode("update").format("memory").queryName("trails").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r.entity: (r.points, r.newest) for r in spark.table("trails").groupBy("entity").agg(F.max("points").alias("points"),
            F.max("newest").alias("newest")).collect()}
    batch = rows_(source).groupBy("entity").agg(F.least(F.lit(30), F.count("*")).alias("points"), F.max("ts_us").alias("newest")).collect()
    assert got == {r.entity: (r.points, r.newest) for r in batch}
