"""Queries over quakes, launches, re-entries, space weather, vessel anomalies, conflict records and map points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hazards
from .shims import LAT_SQL, LON_SQL, lat_of, lon_of, table
from .signal_queries import _at, _pick

AS_OF = "2024-01-15 00:00:00"
ALERTS = ("red", "orange", "yellow", "green", "")
KINDS = ("GAP", "encounter_x", "Loitering", "fishing", "PORT visit", "other")
CODES = ("US", "RU", "CN", "ZZ", "")
LINES = ("Space Weather Message Code: X", "Issue Time: now", "ALERT: kp", "  ", "Second line")


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    properties = F.struct(F.when(k % 9 != 0, (k % 90) / F.lit(10.0)).alias("mag"),
        F.when(k % 4 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("place"), F.when(k % 5 != 0, k * 1000).alias("time"),
        (k % 3).alias("tsunami"), F.nullif(_pick(ALERTS, k * 3), F.lit("")).alias("alert"), F.lit(None).cast("string").alias("url"),
        F.when(k % 2 == 0, k).alias("sig"))
    geometry = F.struct(F.when(k % 8 != 0, F.array(lon_of(k), lat_of(k), (k % 700).cast("double"))).alias("coordinates"))
    rows = table(spark, sf_dir, "orders").select(F.when(k % 6 != 0, k.cast("string")).alias("id"), properties.alias("properties"),
        geometry.alias("geometry"), k.alias("k"))
    out = hazards.quakes(rows)
    return out.where("id is not null").groupBy("color", "tsunami", "alert").agg(F.count("*").alias("n"), F.sum("sig").alias("sig"),
        F.sum("depth").cast("long").alias("depth"), F.count("time").alias("timed"), F.count_if(F.col("place") == "").alias("nowhere"))


def launch_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    row = lambda m: table(spark, sf_dir, "customer").where(k % 3 == m).select(F.concat(F.lit("pad"), k.cast("string")).alias("pad"),
        F.when(k % 10 != 0, lat_of(k % 50)).otherwise(0.0).alias("lat"), lon_of(k % 50).alias("lon"), k.alias("ord"))
    return hazards.pads(row(0), row(1)).select("pad", "has_upcoming")


def launches_at_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    places = table(spark, sf_dir, "supplier").select(k.alias("place"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))
    rows = table(spark, sf_dir, "customer").select(c.alias("id"), (c * 7 % 1009).alias("ord"),
        (lat_of(c % 100) + (c % 13) / F.lit(100.0)).alias("lat"), (lon_of(c % 100) - (c % 7) / F.lit(100.0)).alias("lon"))
    return hazards.launch_at(places, rows)


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    epoch = F.date_format(F.timestamp_seconds(F.lit(1705276800) + (k % 3000 - 100) * 600), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("NORAD_CAT_ID"), F.when(k % 5 != 0, F.concat(F.lit("obj"), k.cast("string"))).alias("OBJECT_NAME"),
            F.when(k % 11 != 0, epoch).alias("DECAY_EPOCH"), (k % 40).cast("string").alias("WINDOW"),
        F.lit("x").alias("INCLINATION"), (k % 400).cast("string").alias("APOGEE"), F.lit("").alias("PERIGEE"),
            _pick(CODES, k).alias("COUNTRY_CODE"), F.when(k % 7 == 0, "n/a").otherwise(lat_of(k).cast("string")).alias("LAT"),
        lon_of(k).cast("string").alias("LON"), F.when(k % 6 == 0, "Y").otherwise("N").alias("HIGH_INTEREST"),
        F.when(k % 8 != 0, F.concat(F.lit("1998-"), k.cast("string"))).alias("OBJECT_ID"),
            F.when(k % 9 != 0, F.lit("2024-01-14")).alias("MSG_EPOCH"),
    )


def decays(spark: SparkSession, sf_dir: str) -> DataFrame:
    countries = spark.createDataFrame([("US", 40.0, -100.0), ("RU", 60.0, 90.0), ("CN", 35.0, 105.0), ("INTL", 0.0, 0.0)],
        "code string, lat double, lon double")
    out = hazards.decays(_objects(spark, sf_dir), countries, _as_of())
    thousandth = lambda x: F.floor(F.col(x) * 1000 + 0.5).cast("long")
    return out.select("id", "name", "object_id", "decay_epoch", "msg_epoch", "country", "window", "apogee", "perigee",
        thousandth("days_left").alias("days"), "color", thousandth("lat").alias("lat"), thousandth("lon").alias("lon"))


def reentries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hazards.reentries(_objects(spark, sf_dir), _as_of())
    return out.select("id", "name", "country", "high_interest", F.floor(F.col("hours_left") * 1000 + 0.5).cast("long").alias("hours"),
        "color")


def soonest_reentries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 50 next re-entries."""
    return hazards.soonest(hazards.reentries(_objects(spark, sf_dir), _as_of()), "hours_left", 9999.0).limit(50).select("id")


def space_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    scales = spark.createDataFrame([("2", "x", None)], "g string, s string, r string")
    kp = ev.select(F.struct("ts", k.alias("k")).alias("time"), F.when(k % 3 == 0, "bad").otherwise((k % 9).cast("string")).alias("kp"))
    alerts = ev.select(F.when(k % 2 == 0, k.cast("string")).alias("product_id"), F.col("ts").alias("issued"),
        F.concat_ws("\n", _pick(LINES, k), _pick(LINES, k * 2 + 1), _pick(LINES, k * 3)).alias("message"), k.alias("ord"))
    out = hazards.space_weather(scales, kp, alerts, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return out.select("g", "s", "r", F.col("kp").cast("long").alias("kp"),
        F.array_join(F.transform("alerts", lambda a: F.concat(F.when(a["ord"] % 2 == 0, a["id"]).otherwise("ts"), F.lit("="),
                    a["headline"])), ";").alias("alerts"))


def vessel_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.timestamp_seconds(F.lit(1700000000) + k * 60)
    raw = table(spark, sf_dir, "orders").select(
        F.when(k % 4 != 0, k.cast("string")).alias("id"), _pick(KINDS, k * 5).alias("type"),
            F.when(k % 10 != 0, lat_of(k % 60)).alias("lat"), lon_of(k % 60).alias("lon"), F.when(k % 3 != 0, start).alias("start"),
        F.when(k % 7 != 0, F.timestamp_seconds(F.lit(1700000000) + k * 60 + (k % 800) * 86400)).alias("end"),
            F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 5).cast("string"))).alias("vessel_id"), k.alias("ord"),
    )
    return hazards.vessel_anomalies(raw).select("id", "kind", "confidence", "minutes", "vessel_id")


def conflict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("k").alias("kind"),
            F.col("o_orderpriority").alias("sub_kind"), F.lit("a").alias("actor1"), F.col("o_orderstatus").alias("country"),
        F.when(k % 6 != 0, (k % 25).cast("int")).alias("fatalities"),
            F.when(k % 5 == 0, "").when(k % 5 == 1, F.repeat(F.lit("ab "), 70)).otherwise(F.concat(F.lit("note "), k.cast("string"))).alias(
                "notes"),
    )
    return hazards.conflict_records(rows, F.lit("1995-01-01"), F.lit("1995-02-15"))


def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features of points that share places, read back from their JSON."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), lat_of(k % 70).alias("lat"), lon_of(k % 70).alias("lon"),
        F.lit("x").alias("kind"))
    made = hazards.geojson(hazards.spread(points), "kind", "n", "at")
    back = F.from_json("feature",
        "type string, geometry struct<type string, coordinates array<double>>, properties struct<kind string, n long, at long>")
    rows = made.select("id", back.alias("b"))
    return rows.select("id", F.col("b.properties.n").alias("n"), F.col("b.properties.at").alias("at"),
        *(F.floor(F.get("b.geometry.coordinates", F.lit(i)) * 10000 + 0.5).cast("long").alias(x) for i, x in enumerate(("lon", "lat"))))


def map_spiral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that share places on the golden-angle spirals of the two layers."""
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(k.alias("id"), lat_of(k % 200).alias("lat"), lon_of(k % 200).alias("lon"))
    wide = hazards.spiral(points, 3, 0.018).select("id", F.col("map_lat").alias("wide_lat"), F.col("map_lon").alias("wide_lon"))
    rows = hazards.spiral(points, 4, 0.015).join(wide, "id")
    return rows.select("id", "at", *(F.floor(F.col(c) * 100000 + 0.5).cast("long").alias(c)
            for c in ("map_lat", "map_lon", "wide_lat", "wide_lon")))


def cell_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    out = hazards.cell_counts(table(spark, sf_dir, "orders").select(lat_of(k).alias("lat"), lon_of(k).alias("lon")), 20)
    return out.select("cell_lat", "cell_lon", "n", F.floor(F.col("share") * 10000 + 0.5).cast("long").alias("share"))


def countdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), hazards.countdown((k % 5000 - 100).cast("long")).alias("told"))


QUERIES = {f.__name__: f for f in (quakes, launch_pads, launches_at_pads, decays, reentries, soonest_reentries, space_weather,
        vessel_anomalies, conflict_records, map_features, map_spiral, cell_shares, countdowns)}

_K = "o_orderkey"
_OBJECTS = f"""(SELECT {_K} AS k, {_K}::VARCHAR AS id, CASE WHEN {_K} % 5 <> 0 THEN 'obj' || {_K} ELSE 'NORAD ' || {_K} END AS name, CASE WHEN {_K} % 11 <> 0 THEN ({_K} % 3000 - 100) * 600 END AS left_,
  coalesce(nullif({_at(CODES, _K)}, ''), 'INTL') AS country FROM orders)"""
_LINE = f"[{_at(LINES, 'event_id')}, {_at(LINES, 'event_id * 2 + 1')}, {_at(LINES, 'event_id * 3')}]"
SQL = {
    "quakes": f"""WITH q AS (SELECT CASE WHEN {_K} % 9 <> 0 THEN ({_K} % 90) / 10.0::DOUBLE ELSE 0 END AS mag, {_K} % 3 <> 0 AS tsunami, nullif({_at(ALERTS, _K + ' * 3')}, '') AS alert, CASE WHEN {_K} % 2 = 0 THEN {_K} ELSE 0 END AS sig,
  CASE WHEN {_K} % 8 <> 0 THEN {_K} % 700 ELSE 0 END AS depth, {_K} % 5 <> 0 AS timed, {_K} % 4 = 0 AS nowhere FROM orders)
SELECT CASE alert WHEN 'red' THEN '#ff2244' WHEN 'orange' THEN '#ff6600' WHEN 'yellow' THEN '#ffaa00' ELSE CASE WHEN mag >= 7 THEN '#ff2244' WHEN mag >= 6 THEN '#ff6600' WHEN mag >= 5 THEN '#ffaa00' ELSE '#ffdd55' END END AS color,
  tsunami, alert, count(*) AS n, sum(sig)::BIGINT AS sig, sum(depth)::BIGINT AS depth, count(*) FILTER (timed) AS timed, count(*) FILTER (nowhere) AS nowhere FROM q GROUP BY ALL""",
    "launch_pads": """WITH r AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS up, c_custkey % 50 AS p FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 10 <> 0 AND (c_custkey % 50 * 104729) % 36000 <> 18000)
SELECT 'pad' || coalesce(max(k) FILTER (up), min(k)) AS pad, bool_or(up) AS has_upcoming FROM r GROUP BY p""",
    "launches_at_pads": f"""SELECT s_suppkey AS place, arg_min(c_custkey, c_custkey * 7 % 1009) AS launch FROM supplier, customer
WHERE abs({LAT_SQL.format(k="s_suppkey")} - ({LAT_SQL.format(k="(c_custkey % 100)")} + (c_custkey % 13) / 100.0::DOUBLE)) < 0.05::DOUBLE AND abs({LON_SQL.format(k="s_suppkey")} - ({LON_SQL.format(k="(c_custkey % 100)")} - (c_custkey % 7) / 100.0::DOUBLE)) < 0.05::DOUBLE GROUP BY 1""",
    "reentries": f"""SELECT id, name, country, k % 6 = 0 AS high_interest, floor(left_ / 3600.0::DOUBLE * 1000 + 0.5)::BIGINT AS hours, CASE WHEN left_ < 21600 THEN '#ff2244' WHEN left_ < 86400 THEN '#ff6600' WHEN left_ < 259200 THEN '#ffaa00' ELSE '#ffdd55' END AS color
FROM {_OBJECTS} WHERE k % 7 <> 0 AND (left_ IS NULL OR left_ >= -21600)""",
    "soonest_reentries": f"SELECT id FROM {_OBJECTS} WHERE k % 7 <> 0 AND (left_ IS NULL OR left_ >= -21600) ORDER BY coalesce(left_ / 3600.0::DOUBLE, 9999), id LIMIT 50",
    "space_weather": f"""WITH a AS (SELECT event_id AS k, list_filter(list_transform({_LINE}, lambda x: trim(x)), lambda x: x <> '') AS lines FROM events WHERE ts > TIMESTAMP '2024-01-18 00:00:00' ORDER BY event_id LIMIT 8),
h AS (SELECT k, coalesce(list_filter(lines, lambda x: NOT starts_with(x, 'Space Weather Message Code') AND NOT starts_with(x, 'Issue Time'))[1], lines[1], '')[1:120] AS h FROM a),
n AS (SELECT arg_max(event_id, {{t: ts, k: event_id}}) AS k FROM events)
SELECT 2 AS g, 0 AS s, 0 AS r, (SELECT CASE WHEN k % 3 <> 0 AND k % 9 <> 0 THEN k % 9 END FROM n) AS kp, (SELECT string_agg(CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'ts' END || '=' || h, ';' ORDER BY k) FROM h) AS alerts""",
    "vessel_anomalies": f"""WITH r AS (SELECT {_K} AS k, lower({_at(KINDS, _K + ' * 5')}) AS t, {_K} % 60 AS p, CASE WHEN {_K} % 3 <> 0 AND {_K} % 7 <> 0 THEN {_K} % 800 * 1440 END AS minutes, CASE WHEN {_K} % 2 = 0 THEN 'v' || {_K} % 5 END AS vessel_id FROM orders WHERE {_K} % 10 <> 0),
c AS (SELECT *, CASE WHEN contains(t, 'gap') THEN 'dark_shipping' WHEN contains(t, 'encounter') THEN 'vessel_encounter' WHEN contains(t, 'loiter') THEN 'loitering' WHEN contains(t, 'fishing') THEN 'fishing_activity' WHEN contains(t, 'port') THEN 'port_visit' ELSE 'maritime_anomaly' END AS kind FROM r WHERE minutes IS NULL OR minutes <= 525600)
SELECT CASE WHEN k % 4 <> 0 THEN k::VARCHAR ELSE 'gfw-' || kind || '-' || k END AS id, kind, CASE kind WHEN 'dark_shipping' THEN 80 WHEN 'vessel_encounter' THEN 70 WHEN 'loitering' THEN 65 WHEN 'fishing_activity' THEN 50 WHEN 'port_visit' THEN 40 ELSE 55 END AS confidence, minutes, vessel_id
FROM c QUALIFY row_number() OVER (PARTITION BY kind, floor(({LAT_SQL.format(k="p")}) * 10 + 0.5), floor(({LON_SQL.format(k="p")}) * 10 + 0.5), coalesce(vessel_id, '') ORDER BY k) = 1""",
    "conflict_records": f"""WITH r AS (SELECT {_K} AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN {_K} % 6 <> 0 THEN {_K} % 25 ELSE 0 END AS dead, CASE {_K} % 5 WHEN 0 THEN o_orderpriority || ' - ' || o_orderstatus WHEN 1 THEN rtrim(repeat('ab ', 70)) ELSE 'note ' || {_K} END AS t FROM orders
WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-02-16' ORDER BY day DESC, id LIMIT 500)
SELECT id, day, CASE WHEN length(t) > 180 THEN t[1:177] || '...' ELSE t END AS title, CASE WHEN dead >= 20 THEN -10 WHEN dead >= 10 THEN -8 WHEN dead >= 5 THEN -6 WHEN dead >= 1 THEN -4 ELSE -2 END AS tone, 100 + 5 * dead AS score FROM r""",
    "map_features": f"""WITH p AS (SELECT c_custkey AS id, {LAT_SQL.format(k="(c_custkey % 70)")} AS lat, {LON_SQL.format(k="(c_custkey % 70)")} AS lon FROM customer),
r AS (SELECT *, count(*) OVER (PARTITION BY floor(lat * 100 + 0.5), floor(lon * 100 + 0.5)) AS n, row_number() OVER (PARTITION BY floor(lat * 100 + 0.5), floor(lon * 100 + 0.5) ORDER BY id) - 1 AS "at" FROM p)
SELECT id, n, "at", floor((lon + CASE WHEN n > 1 THEN cos("at" * 2 * pi() / n) * 0.18::DOUBLE ELSE 0 END) * 10000 + 0.5)::BIGINT AS lon, floor((lat + CASE WHEN n > 1 THEN sin("at" * 2 * pi() / n) * 0.18::DOUBLE ELSE 0 END) * 10000 + 0.5)::BIGINT AS lat FROM r""",
    "decays": f"""WITH c(code, lat, lon) AS (VALUES ('US', 40.0::DOUBLE, -100.0::DOUBLE), ('RU', 60.0, 90.0), ('CN', 35.0, 105.0), ('INTL', 0.0, 0.0)),
d AS (SELECT o.*, c.lat, c.lon, CASE WHEN left_ IS NOT NULL THEN greatest(0, left_) / 86400.0::DOUBLE END AS days_left FROM {_OBJECTS} o JOIN c ON c.code = o.country WHERE left_ IS NULL OR left_ >= -21600)
SELECT id, name, CASE WHEN k % 8 <> 0 THEN '1998-' || k ELSE '' END AS object_id, strftime(TIMESTAMP '2024-01-15 00:00:00' + to_seconds(left_), '%Y-%m-%d %H:%M:%S') AS decay_epoch, CASE WHEN k % 9 <> 0 THEN '2024-01-14' END AS msg_epoch,
  country, (k % 40)::DOUBLE AS "window", (k % 400)::DOUBLE AS apogee, 0.0::DOUBLE AS perigee, floor(days_left * 1000 + 0.5)::BIGINT AS days,
  CASE WHEN days_left < 3 THEN '#ff2244' WHEN days_left < 7 THEN '#ff6600' WHEN days_left < 14 THEN '#ffaa00' ELSE '#ffdd55' END AS color,
  floor((lat + (('0x' || md5('a' || id)[1:8])::BIGINT / 4294967296.0::DOUBLE - 0.5) * 8) * 1000 + 0.5)::BIGINT AS lat, floor((lon + (('0x' || md5('o' || id)[1:8])::BIGINT / 4294967296.0::DOUBLE - 0.5) * 8) * 1000 + 0.5)::BIGINT AS lon FROM d""",
    "map_spiral": f"""WITH p AS (SELECT o_orderkey AS id, {LAT_SQL.format(k="(o_orderkey % 200)")} AS lat, {LON_SQL.format(k="(o_orderkey % 200)")} AS lon FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY floor(lat * 10000 + 0.5), floor(lon * 10000 + 0.5) ORDER BY id) - 1 AS n, row_number() OVER (PARTITION BY floor(lat * 1000 + 0.5), floor(lon * 1000 + 0.5) ORDER BY id) - 1 AS m FROM p)
SELECT id, n AS "at", floor((lat + ceil(n / 6.0::DOUBLE) * 0.015::DOUBLE * cos(radians(n * 137.5::DOUBLE))) * 100000 + 0.5)::BIGINT AS map_lat, floor((lon + ceil(n / 6.0::DOUBLE) * 0.015::DOUBLE * sin(radians(n * 137.5::DOUBLE))) * 100000 + 0.5)::BIGINT AS map_lon,
  floor((lat + ceil(m / 6.0::DOUBLE) * 0.018::DOUBLE * cos(radians(m * 137.5::DOUBLE))) * 100000 + 0.5)::BIGINT AS wide_lat, floor((lon + ceil(m / 6.0::DOUBLE) * 0.018::DOUBLE * sin(radians(m * 137.5::DOUBLE))) * 100000 + 0.5)::BIGINT AS wide_lon FROM r""",
    "cell_shares": f"""WITH c AS (SELECT (floor(({LAT_SQL.format(k=_K)}) / 20 + 0.5) * 20)::INT AS cell_lat, (floor(({LON_SQL.format(k=_K)}) / 20 + 0.5) * 20)::INT AS cell_lon, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, floor(n::DOUBLE / greatest((SELECT max(n) FROM c), 1) * 10000 + 0.5)::BIGINT AS share FROM c""",
    "countdowns": f"""WITH m AS (SELECT {_K} AS id, {_K} % 5000 - 100 AS m FROM orders) SELECT id, CASE WHEN m < 0 THEN 'LAUNCHED' WHEN m >= 1440 THEN printf('T-%dd %02d:%02d', m // 1440, m // 60 % 24, m % 60) ELSE printf('T-%02d:%02d', m // 60 % 24, m % 60) END AS told FROM m""",
}
