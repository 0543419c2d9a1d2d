"""Cases behind the findings of round 4, against SQL or a plain loop."""

import duckdb
import pytest

from skein.plans import catalogue
from tests.test_queries import FOLDER, TABLES, rows


def folder_with(tmp_path, **tables):
    """The tables of sf0.001, some of them replaced by a query over them; the folder and a database of it."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t}_0 AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        con.execute(f"COPY ({tables.get(t, f'SELECT * FROM {t}_0')}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return str(tmp_path), con


def same_as_sql(spark, name, folder, con):
    df = catalogue.queries()[name](spark, folder)
    oracle = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in oracle.description]
    assert sorted(columns) == sorted(df.columns)
    return rows(df.columns, df.collect()) == rows(columns, oracle.fetchall())


@pytest.mark.parametrize("name", ["a_curated_events", "quota_selection", "keep_best"])
def test_events_without_mentions_or_coverage_count_as_none(spark, tmp_path, name):
    """F8: ids over 999 have no mentions, and copies of one text differ only in what is unknown of them."""
    folder, con = folder_with(tmp_path, documents="SELECT doc_id + 1247 * k AS doc_id, text, lang, source, n_chars FROM documents_0, range(20) r(k)")
    assert same_as_sql(spark, name, folder, con)


SPOTS = [(i, (i * 37 % 1801) / 10 - 90.0, (i * 101 % 3607) / 10 - 180.0) for i in range(1500)] + [(9000, 90.0, 0.0), (9001, -90.0, 10.0),
    (9002, 0.0, 180.0), (9003, 0.0, -180.0), (9004, None, 1.0), (9005, 2.0, float("nan")), (9006, 89.9, 179.0)]


@pytest.fixture(scope="module")
def places(spark):
    """Rows, places with a radius, and all distances between them."""
    from pyspark.sql import functions as F

    from skein.functions.geo import haversine

    a = spark.createDataFrame(SPOTS, "seq long, lat double, lon double").repartition(4)
    b = a.where("seq % 2 = 0").select((F.col("seq") * 3 % 9007).alias("site"), F.col("lat").alias("site_lat"),
        F.col("lon").alias("site_lon"), (F.col("seq") % 9 * 100 + 150).cast("double").alias("radius_km"))
    km = haversine(a["lat"], a["lon"], b["site_lat"], b["site_lon"])
    every = [tuple(r) for r in a.crossJoin(b).select("seq", "site", "radius_km", km.alias("km")).where("km <= 12000").collect()]
    return a, b, every


@pytest.fixture()
def made(monkeypatch):
    """How many pairs the distance joins of a test gave."""
    from skein.operators import spatial

    counts, own = [], spatial.near_pairs

    def counted(*args, **more):
        counts.append(own(*args, **more))
        return counts[-1]

    monkeypatch.setattr(spatial, "near_pairs", counted)
    return lambda: sum(df.count() for df in counts)


@pytest.mark.parametrize("km", [40.0, 2500.0, 11000.0])
def test_counts_within_a_circle_make_no_pairs_of_what_lies_well_inside(spark, places, made, km):
    """counts by cells, over the poles and the date line and beyond a quarter of the globe."""
    from skein.operators import spatial

    a, b, every = places
    want = {}
    for _, site, _, d in every:
        if d <= km:
            want[site] = want.get(site, 0) + 1
    assert {r.site: r.n for r in spatial.count_within(a, b, "site", km).collect()} == want
    assert made() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_places_look_near_first(spark, places, made, k):
    """the same as of all pairs in reach, of which hardly any are made."""
    from skein.operators import spatial

    a, b, every = places
    want, reach = {}, 0
    for seq, site, _, d in every:
        if d <= 4000.0:
            want.setdefault(seq, []).append((d, site))
            reach += 1
    best = {(seq, site, i + 1) for seq, found in want.items() for i, (_, site) in enumerate(sorted(found)[:k])}
    assert {(r.seq, r.site, r.rank) for r in spatial.top_within(a, b, "seq", "site", 4000.0, k).collect()} == best
    assert made() < reach / 2


def test_first_zones_are_taken_in_their_order(spark, places, made, monkeypatch):
    """later zones are only looked at for rows that no earlier one holds."""
    from skein.operators import spatial

    a, b, every = places
    want, reach = {s[0]: None for s in SPOTS}, 0
    for seq, site, radius, d in every:
        if d <= min(radius, 900.0):
            want[seq], reach = site if want[seq] is None else min(site, want[seq]), reach + 1
    monkeypatch.setattr(spatial, "ZONE_LAYERS", 0.2)
    monkeypatch.setattr(spatial, "MORE_ZONES", 2)
    got = spatial.first_zone(a, b, "seq", "site", 900.0).collect()
    assert len(got) == len(SPOTS) and {r.seq: r.site for r in got} == want
    assert made() < reach * 0.8


def test_sites_near_ships_in_more_than_one_look(spark, tmp_path):
    """with so many sites that the nearest five are looked for in several steps."""
    folder, con = folder_with(tmp_path, supplier="SELECT s_suppkey + 977 * k AS s_suppkey FROM supplier_0, range(300) r(k)")
    assert same_as_sql(spark, "ship_tracks_scored", folder, con)


def test_context_looks_for_each_kind_apart(spark, tmp_path, made):
    """with many sites, equal to SQL without all pairs within the widest radius."""
    folder, con = folder_with(tmp_path, supplier="SELECT s_suppkey + 977 * k AS s_suppkey FROM supplier_0, range(5000) r(k)")
    assert same_as_sql(spark, "anomaly_context", folder, con)
    from skein.plans.shims import km_sql
    from skein.plans.signal_queries import ANOMALY_SQL, PLACE_SQL

    km = km_sql("r.lat", "r.lon", "p.site_lat", "p.site_lon")
    assert made() < con.execute(f"SELECT count(*) FROM {ANOMALY_SQL} r, {PLACE_SQL} p WHERE {km} <= radius").fetchone()[0]


def test_best_anomalies_are_looked_for_by_bonus(spark, tmp_path, monkeypatch):
    """with many anomalies, equal to SQL with fewer pairs than there are within 220 km."""
    from skein.operators import signals
    from skein.plans.shims import km_sql
    from skein.plans.signal_queries import ANOMALY_SQL, REPORT_SQL

    looks, own = [], signals.near_pairs
    monkeypatch.setattr(signals, "near_pairs", lambda rows, *args, **more: looks.append(own(rows, *args, **more)) or looks[-1])
    folder, con = folder_with(tmp_path, customer="SELECT c_custkey + 163 * k AS c_custkey FROM customer_0, range(800) r(k)")
    assert same_as_sql(spark, "naval_activity", folder, con)
    km = km_sql("r.lat", "r.lon", "a.lat", "a.lon")
    ids = catalogue.queries()["naval_activity"](spark, folder).select("id").toPandas()  # noqa: F841
    every = con.execute(f"SELECT count(*) FROM {REPORT_SQL} r, {ANOMALY_SQL} a WHERE r.id IN (SELECT id FROM ids) AND {km} <= 220").fetchone()[0]
    assert looks[0].count() < every / 2


def test_objects_in_answers_are_found_once(spark):
    """whatever is taken from an answer, its marks are gone through once."""
    df = catalogue.queries()["broken_answers"](spark, FOLDER)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


@pytest.mark.parametrize("name", ["news_duplicates", "news_gray_pairs", "news_without_gray"])
def test_news_pairs_of_many_tiles(spark, tmp_path, monkeypatch, name):
    """only items are shuffled; with many small tiles and groups of rows, equal to SQL."""
    from skein.operators import news

    monkeypatch.setattr(news, "TILE", 30)
    monkeypatch.setattr(news, "AT_ONCE", 7)
    folder, con = folder_with(tmp_path, documents="SELECT doc_id + 211 * k AS doc_id, text, lang, source, n_chars FROM documents_0, range(5) r(k)")
    assert same_as_sql(spark, name, folder, con)
