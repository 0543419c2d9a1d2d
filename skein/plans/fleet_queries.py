"""Queries over aircraft and ships made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fleets, scoring, spatial
from .shims import LAT_SQL, LON_SQL, SITE_SQL, km_sql, lat_of, lon_of, sites, table
from .signal_queries import _at, _pick, _q

CALLS = ("RCH12", "  nato01 ", "DLH400", "", "XYZ", "irgc7", "CCA988")
BASES = tuple(str(x) for x in (0xADF7C8, 0x3B7000, 0x738000, 0x100000, 0x2A0000, 0x7C4200, 0x4B0000, 0x456000, 0x000001))
CRAFT = ("E3", " kc135 ", "RC135", "F16", "MIG29", "", "H60", "KA52")
SHIP_NAMES = ("USS Nimitz", "Ever Given", "HMS Queen", "ADMIRAL X@@", "", "Slava")
MIDS = ("338", "0232", "211", "00338", "412", "0999", "57")
HELICOPTERS = ("H60", "UH60", "CH47", "AH64", "NH90")


def _hex(k):
    return F.lower(F.lpad(F.hex(_pick(BASES, k).cast("long") + k % 9000), 6, "0"))


_HEX_SQL = f"printf('%06x', {_at(BASES, '{k}')}::BIGINT + {{k}} % 9000)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(F.array(
        F.upper(_hex(k)), _pick(CALLS, k * 3), nothing, nothing, nothing, F.when(k % 17 != 0, text(k * 104729 % 36000 - 18000)),
            F.when(k % 19 != 0, text(k * 7919 % 17001 - 8500)),
        F.when(k % 5 != 0, text(k % 12000)), F.when(k % 7 == 0, "true").otherwise("false"), F.when(k % 6 != 0, text(k % 250)),
            F.when(k % 8 != 0, text(k % 360)),
    ).alias("state"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.when(k % 10 == 0, "~").otherwise(""), _hex(k * 7)).alias("hex"), _pick(CALLS, k).alias("flight"),
            F.when(k % 4 == 0, "REG" ).alias("r"), _pick(CRAFT, k).alias("t"),
        F.when(k % 21 != 0, lat_of(k)).alias("lat"), lon_of(k).alias("lon"),
            F.when(k % 13 == 0, "ground").when(k % 13 == 1, None).otherwise((k * 37 % 45000).cast("string")).alias("alt_baro"),
        F.when(k % 29 == 0, True).alias("on_ground"), F.when(k % 9 != 0, (k % 600).cast("double") + 0.5).alias("gs"),
            F.when(k % 8 != 0, (k % 360).cast("double")).alias("track"),
    )


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(_pick(MIDS, k), F.lpad(k.cast("string"), 5, "0")).alias("id"), _pick(SHIP_NAMES, k).alias("name"),
            F.when(k % 3 == 0, "CS").alias("callsign"), F.when(k % 4 == 0, "FRA").alias("country"),
        lon_of(k).alias("lon"), lat_of(k).alias("lat"), F.when(k % 5 != 0, k % 30).alias("sog"), F.when(k % 6 != 0, k % 360).alias("cog"),
            F.when(k % 7 == 0, 511).otherwise(k % 360).alias("heading"),
        F.when(k % 8 == 0, 70).alias("ship_type"), (k % 9 != 0).alias("verified"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        u.alias("entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), k.alias("seq"),
            (F.lit(40.0) + k % 7 / F.lit(10.0)).alias("lat"), (F.lit(5.0) + k % 11 / F.lit(10.0)).alias("lon"),
        (k * 37 % 360).cast("double").alias("heading"),
            F.when(u % 3 == 0, F.lit(400.0) + k % 20).otherwise(F.lit(100.0) + k % 300).alias("speed"),
        F.when(u % 2 == 0, F.lit(30000) + k % 1000).otherwise(k * 31 % 40000).alias("alt_ft"), _pick(CRAFT, u).alias("craft_type"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(_pick(MIDS, u), F.lpad(u.cast("string"), 5, "0")).alias("number"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), k.alias("seq"),
        F.when(F.col("event_type") == "signup", "static").when(F.col("event_type") == "view", "position").otherwise("other").alias("kind"),
            _pick(SHIP_NAMES, k).alias("name"),
        F.when(k % 5 == 0, 35).otherwise(70).alias("ship_type"),
            F.when(k % 30 == 0, 91.0).when(k % 31 == 0, 0.0).otherwise(lat_of(k)).alias("lat"),
            F.when(k % 31 == 0, 0.0).otherwise(lon_of(k)).alias("lon"),
    )


def aircraft_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleets.from_states(states(spark, sf_dir)).where("reject is null").drop("reject", "type")


def aircraft_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleets.from_objects(objects(spark, sf_dir)).where("reject is null").drop("reject")


def aircraft_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows by country and rejected ones by reason, of both wire formats."""
    return fleets.reject_counts(fleets.from_states(states(spark, sf_dir)).unionByName(fleets.from_objects(objects(spark, sf_dir))))


def aircraft_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft of both formats, an object before a state of the same address."""
    return fleets.fused(fleets.from_objects(objects(spark, sf_dir)), fleets.from_states(states(spark, sf_dir))).select("id", "callsign",
        "country")


_SHOWN = ["id", "name", "callsign", "country", "speed", "heading", "cog", "sog"]


def air_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).where("lat is not null")
    raw = rows.select(F.regexp_replace("hex", "^~", "").alias("id"), F.col("flight").alias("callsign"),
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("color"), "lon", "lat",
        F.lit(None).cast("long").alias("alt"), F.col("alt_baro").try_cast("long").alias("alt_ft"), F.col("gs").alias("speed"), "track",
        F.col("t").alias("type"))
    return fleets.air_tracks(raw, HELICOPTERS).select(*_SHOWN, "color", "is_helicopter", "military_hex", "no_callsign")


def sea_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleets.sea_tracks(ships(spark, sf_dir)).select(*_SHOWN, "ship_type", "warship_number", "navy_country")


def air_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fleets.air_activity(reports(spark, sf_dir))
    return out.withColumn("confidence", F.floor(F.col("confidence") * 100 + 0.5).cast("long"))


def verified_ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleets.verified_ships(messages(spark, sf_dir)).select("seq", "number", "ship", "country")


def ship_tracks_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track pipeline at sea: normal tracks, rules, tiers, those at least likely, each with its sites nearby."""
    rows = fleets.sea_tracks(ships(spark, sf_dir)).withColumns(
        {"callsign": F.lit(None).cast("string"), "military_type": F.lit(False), "base_km": F.lit(None).cast("double")})
    score, reasons = scoring.rule_score(F.col("domain"), scoring.track_rules())
    rows = rows.withColumn("score", score.cast("long")).withColumn("tier", scoring.tier(F.col("score"))).withColumn("n_reasons",
        F.size(reasons).cast("long"))
    rows = fleets.chosen_tracks(rows, least_tier="likely")
    near = spatial.top_within(rows, sites(spark, sf_dir), "id", "site", 1500.5, 5)
    listed = near.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "site"))),
                lambda x: x["site"].cast("string")), ";").alias("near"))
    return rows.join(listed, "id", "left").select("id", "score", "tier", "n_reasons", F.coalesce("near", F.lit("")).alias("near"))


QUERIES = {f.__name__: f for f in (aircraft_states, aircraft_objects, aircraft_rejects, aircraft_fused, air_tracks, sea_tracks,
        air_activity, verified_ships, ship_tracks_scored)}


def _range_sql(ranges, value: str, column: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} BETWEEN {r[0]} AND {r[1]} THEN '{r[column]}'" for r in ranges) + " END"


_RE = lambda text, pattern: f"regexp_matches({text}, {_q(pattern)})"


def _military(column: int) -> str:
    other = "UNKNOWN" if column == 2 else "#e8f4ff"
    return f"CASE WHEN {_RE('trim(callsign0)', fleets.CIVIL_CALLSIGN)} THEN NULL ELSE coalesce({_range_sql(fleets.INGEST_RANGES, 'value', column)}, CASE WHEN {_RE('trim(callsign0)', fleets.CALLSIGN)} THEN '{other}' END) END"


def _accepted(inner: str) -> str:
    return f"SELECT *, {_military(2)} AS country0, {_military(3)} AS color0, coalesce(nullif(trim(callsign0), ''), upper(id)) AS callsign FROM ({inner})"


_K = "o_orderkey"
STATE_SQL = f"""(SELECT *, CASE WHEN coalesce(lon, 0) = 0 OR coalesce(lat, 0) = 0 THEN 'no_position' WHEN grounded THEN 'on_ground' WHEN country0 IS NULL THEN 'not_military' END AS reject FROM ({_accepted(f'''
  SELECT {_HEX_SQL.format(k=_K)} AS id, ('0x' || {_HEX_SQL.format(k=_K)})::BIGINT AS value, {_at(CALLS, _K + ' * 3')} AS callsign0,
  CASE WHEN {_K} % 17 <> 0 THEN ({_K} * 104729 % 36000 - 18000)::DOUBLE END AS lon, CASE WHEN {_K} % 19 <> 0 THEN ({_K} * 7919 % 17001 - 8500)::DOUBLE END AS lat,
  CASE WHEN {_K} % 5 <> 0 THEN {_K} % 12000 END AS alt, {_K} % 7 = 0 AS grounded, CASE WHEN {_K} % 6 <> 0 THEN floor(({_K} % 250) * 1.944::DOUBLE + 0.5)::BIGINT END AS speed,
  CASE WHEN {_K} % 8 <> 0 THEN {_K} % 360 ELSE 0 END::DOUBLE AS track FROM orders''')}))"""
_C = "c_custkey"
_BARO = f"CASE WHEN {_C} % 13 > 1 THEN {_C} * 37 % 45000 END"
OBJECT_SQL = f"""(SELECT *, CASE WHEN lat IS NULL THEN 'no_position' WHEN grounded THEN 'on_ground' WHEN country0 IS NULL THEN 'not_military' END AS reject FROM ({_accepted(f'''
  SELECT {_HEX_SQL.format(k=_C + ' * 7')} AS id, ('0x' || {_HEX_SQL.format(k=_C + ' * 7')})::BIGINT AS value, coalesce(nullif({_at(CALLS, _C)}, ''), CASE WHEN {_C} % 4 = 0 THEN 'REG' END, '') AS callsign0,
  CASE WHEN {_C} % 21 <> 0 THEN {LAT_SQL.format(k=_C)} END AS lat, {LON_SQL.format(k=_C)} AS lon, {_BARO} AS alt_ft, floor(({_BARO}) / 3.281::DOUBLE + 0.5)::BIGINT AS alt, {_C} % 13 = 0 OR {_C} % 29 = 0 AS grounded,
  CASE WHEN {_C} % 9 <> 0 THEN {_C} % 600 + 1 END AS speed, CASE WHEN {_C} % 8 <> 0 THEN {_C} % 360 ELSE 0 END::DOUBLE AS track, trim({_at(CRAFT, _C)}) AS type FROM customer''')}))"""
_S = "s_suppkey"
_NUMBER = f"({_at(MIDS, _S)} || lpad({_S}::VARCHAR, 5, '0'))"


def _cut(number: str) -> str:
    digits = f"(CASE WHEN length({number}) >= 9 THEN substr({number}, 1, 9) ELSE lpad({number}, 9, '0') END)"
    return f"CASE WHEN {digits} LIKE '0%' AND {digits} NOT LIKE '00%' THEN substr({digits}, 2) ELSE {digits} END", digits


def _mid(number: str) -> str:
    return f"CASE substr({_cut(number)[0]}, 1, 3) " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in fleets.SHIP_PREFIXES.items()) + " END"


_WARSHIP = lambda number: f"({_cut(number)[1]} LIKE '0%' AND {_cut(number)[1]} NOT LIKE '00%' AND {_mid(number)} IS NOT NULL)"
SHIP_SQL = f"""(SELECT *, {_mid('id')} AS mid, {_WARSHIP('id')} AS warship FROM (SELECT {_S} AS k, {_NUMBER} AS id, {_at(SHIP_NAMES, _S)} AS name0, {LAT_SQL.format(k=_S)} AS lat, {LON_SQL.format(k=_S)} AS lon FROM supplier))"""
_EV = f"""(SELECT user_id AS entity, epoch_us(ts) AS ts_us, event_id AS seq, 40.0::DOUBLE + event_id % 7 / 10.0::DOUBLE AS lat, 5.0::DOUBLE + event_id % 11 / 10.0::DOUBLE AS lon, (event_id * 37 % 360)::DOUBLE AS heading,
  CASE WHEN user_id % 3 = 0 THEN 400.0::DOUBLE + event_id % 20 ELSE 100.0::DOUBLE + event_id % 300 END AS speed, CASE WHEN user_id % 2 = 0 THEN 30000 + event_id % 1000 ELSE event_id * 31 % 40000 END AS alt_ft,
  upper(trim({_at(CRAFT, "user_id")})) AS craft FROM events)"""
_TURN = "coalesce((heading - lag(heading) OVER (PARTITION BY entity ORDER BY ts_us, seq) + 540) % 360 - 180, 0.0)"
_IN = lambda names: "(" + ", ".join(map(_q, names)) + ")"
_YES = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
_MESSAGE_SQL = f"""(SELECT {_at(MIDS, "user_id")} || lpad(user_id::VARCHAR, 5, '0') AS number, epoch_us(ts) AS ts_us, event_id AS seq, event_type, trim(regexp_replace({_at(SHIP_NAMES, "event_id")}, '@+$', '')) AS name,
  event_id % 5 = 0 AS is35, CASE WHEN event_id % 30 = 0 THEN 91.0::DOUBLE WHEN event_id % 31 = 0 THEN 0.0::DOUBLE ELSE {LAT_SQL.format(k="event_id")} END AS lat, CASE WHEN event_id % 31 = 0 THEN 0.0::DOUBLE ELSE {LON_SQL.format(k="event_id")} END AS lon FROM events)"""

SQL = {
    "aircraft_states": f"SELECT id, callsign, country0 AS country, color0 AS color, lon, lat, alt, floor(alt * 3.281::DOUBLE + 0.5)::BIGINT AS alt_ft, speed, track FROM {STATE_SQL} WHERE reject IS NULL",
    "aircraft_objects": f"SELECT id, callsign, country0 AS country, color0 AS color, lon, lat, alt, alt_ft, speed, track, type FROM {OBJECT_SQL} WHERE reject IS NULL",
    "aircraft_rejects": f"""WITH r AS (SELECT reject, country0 FROM {STATE_SQL} UNION ALL SELECT reject, country0 FROM {OBJECT_SQL})
SELECT coalesce(reject, 'accepted') AS outcome, CASE WHEN reject IS NULL THEN country0 END AS country, count(*) AS n FROM r GROUP BY ALL""",
    "aircraft_fused": f"""WITH r AS (SELECT 1 AS s, id, callsign, country0 AS country, floor(alt * 3.281::DOUBLE + 0.5)::BIGINT AS alt_ft, lat FROM {STATE_SQL} WHERE reject IS NULL UNION ALL SELECT 0, id, callsign, country0, alt_ft, lat FROM {OBJECT_SQL} WHERE reject IS NULL)
SELECT id, callsign, country FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, alt_ft DESC NULLS LAST, callsign, lat) = 1""",
    "air_tracks": f"""WITH r AS (SELECT {_HEX_SQL.format(k=_C + ' * 7')} AS id, ('0x' || {_HEX_SQL.format(k=_C + ' * 7')})::BIGINT AS v, nullif(trim({_at(CALLS, _C)}), '') AS cs, CASE WHEN {_C} % 9 <> 0 THEN {_C} % 600 + 0.5::DOUBLE END AS speed, CASE WHEN {_C} % 8 <> 0 THEN ({_C} % 360)::DOUBLE END AS heading,
  upper(trim({_at(CRAFT, _C)})) AS t FROM customer WHERE {_C} % 21 <> 0),
m AS (SELECT *, {_range_sql(fleets.HEX_RANGES, 'v', 2)} AS mil, {_range_sql(fleets.HEX_RANGES, 'v', 3)} AS mil_color FROM r)
SELECT id, coalesce(cs, upper(id)) AS name, coalesce(cs, '') AS callsign, coalesce(mil, 'UNKNOWN') AS country, speed, heading, coalesce(heading, 0) AS cog, coalesce(speed, 0) AS sog, coalesce(mil_color, '#e8f4ff') AS color,
  t IN {_IN(HELICOPTERS)} OR t LIKE 'MI%' OR t LIKE 'KA%' AS is_helicopter, mil IS NOT NULL AS military_hex, cs IS NULL OR cs = upper(id) AS no_callsign FROM m""",
    "sea_tracks": f"""SELECT id, coalesce(nullif(trim(name0), ''), id) AS name, CASE WHEN k % 3 = 0 THEN 'CS' ELSE '' END AS callsign, CASE WHEN k % 4 = 0 THEN 'FRA' ELSE coalesce(mid, 'UNKNOWN') END AS country,
  CASE WHEN k % 5 <> 0 THEN (k % 30)::DOUBLE END AS speed, CASE WHEN k % 7 = 0 THEN NULL ELSE (k % 360)::DOUBLE END AS heading, CASE WHEN k % 6 <> 0 THEN (k % 360)::DOUBLE ELSE 0 END AS cog, CASE WHEN k % 5 <> 0 THEN (k % 30)::DOUBLE ELSE 0 END AS sog,
  CASE WHEN k % 8 = 0 THEN 70 WHEN k % 9 <> 0 THEN 35 END AS ship_type, warship AS warship_number, mid IS NOT NULL AS navy_country FROM {SHIP_SQL}""",
    "air_activity": f"""WITH r AS (SELECT * FROM {_EV} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, seq DESC) <= 30),
c AS (SELECT *, {_TURN} AS step, avg(lat) OVER (PARTITION BY entity) AS mlat, avg(lon) OVER (PARTITION BY entity) AS mlon FROM r), d AS (SELECT *, {km_sql("lat", "lon", "mlat", "mlon")} AS km FROM c),
g AS (SELECT entity, count(*) AS n, abs(sum(step)) AS turned, avg(km) AS mean_km, stddev_pop(km) AS sd_km, count(*) FILTER (speed > 50) AS n_speed, stddev_pop(speed) FILTER (speed > 50) AS sd_speed, avg(speed) FILTER (speed > 50) AS m_speed,
  count(*) FILTER (alt_ft > 0) AS n_alt, stddev_pop(alt_ft) FILTER (alt_ft > 0) AS sd_alt, arg_max(alt_ft, {{t: ts_us, s: seq}}) AS alt, arg_max(craft, {{t: ts_us, s: seq}}) AS kind, max(ts_us) - min(ts_us) AS elapsed FROM d GROUP BY entity),
f AS (SELECT *, n >= 8 AND (turned >= 270 OR (sd_km < 0.25 * mean_km AND mean_km > 5 AND turned > 90)) AS orbit, coalesce(n_speed >= 4 AND sd_speed < 0.1 * m_speed, false) AS even_speed, coalesce(n_alt >= 4 AND sd_alt < 2000, false) AS even_alt FROM g),
p AS (SELECT *, CASE WHEN kind IN {_IN(fleets.AWACS)} THEN 'AWACS' WHEN kind IN {_IN(fleets.TANKER)} THEN 'TANKER' WHEN kind IN {_IN(fleets.ISR)} THEN 'ISR' END AS typed,
  40 + {_YES('even_alt', 20)} + {_YES('even_speed', 20)} + {_YES('n >= 2 AND elapsed >= 1200000000', 20)} AS cap FROM f)
SELECT entity, orbit, even_speed, even_alt, coalesce(typed, CASE WHEN orbit AND cap >= 50 THEN 'CAP' END) AS activity,
  floor(coalesce(CASE typed WHEN 'AWACS' THEN least(1.0::DOUBLE, (60 + {_YES('alt BETWEEN 28000 AND 40000', 20)} + {_YES('even_speed', 10)} + {_YES('orbit', 25)}) / 115.0::DOUBLE)
    WHEN 'TANKER' THEN least(1.0::DOUBLE, (60 + {_YES('alt BETWEEN 18000 AND 32000', 20)} + {_YES('even_speed', 15)}) / 95.0::DOUBLE)
    WHEN 'ISR' THEN least(1.0::DOUBLE, (60 + {_YES('alt >= 20000', 15)} + {_YES('n >= 15', 10)} + {_YES('orbit', 20)}) / 105.0::DOUBLE) END, CASE WHEN orbit AND cap >= 50 THEN least(1.0::DOUBLE, cap / 100.0::DOUBLE) END, 0.0::DOUBLE) * 100 + 0.5)::BIGINT AS confidence FROM p""",
    "verified_ships": f"""WITH m AS (SELECT *, CASE WHEN event_type = 'signup' AND ({_RE('name', fleets.SHIP_NAME)} OR is35) THEN coalesce(nullif(name, ''), number) END AS shown FROM {_MESSAGE_SQL}),
s AS (SELECT *, last_value(shown IGNORE NULLS) OVER (PARTITION BY number ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS known FROM m)
SELECT seq, number, coalesce(known, number) AS ship, {_mid('number')} AS country FROM s WHERE event_type = 'view' AND abs(lat) <= 90 AND NOT (lat = 0 AND lon = 0) AND (known IS NOT NULL OR {_WARSHIP('number')})""",
    "ship_tracks_scored": f"""WITH t AS (SELECT *, coalesce(nullif(trim(name0), ''), id) AS name, CASE WHEN k % 8 = 0 THEN 70 WHEN k % 9 <> 0 THEN 35 END AS ship_type FROM {SHIP_SQL}),
h AS (SELECT *, coalesce(ship_type = 35, false) AS a, warship AS b, {_RE('name', fleets.SHIP_NAME)} AS c, mid IS NOT NULL AS d FROM t),
s AS (SELECT *, least(100, {_YES('a', 70)} + {_YES('b', 60)} + {_YES('c', 80)} + {_YES('d', 20)})::BIGINT AS score, a::BIGINT + b::BIGINT + c::BIGINT + d::BIGINT AS n_reasons FROM h),
n AS (SELECT * FROM (SELECT s.id, p.site, {km_sql("s.lat", "s.lon", "p.site_lat", "p.site_lon")} AS km FROM s, {SITE_SQL} p WHERE score >= 50) WHERE km <= 1500.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, site) <= 5)
SELECT s.id, score, CASE WHEN score >= 75 THEN 'confirmed' ELSE 'likely' END AS tier, n_reasons, coalesce((SELECT string_agg(site::VARCHAR, ';' ORDER BY km, site) FROM n WHERE n.id = s.id), '') AS near FROM s WHERE score >= 50""",
}
