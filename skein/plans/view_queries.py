"""Queries over the day's map, colours and views of the map, envelopes of records, thinned trails and lenient numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import day_map as rules
from ..operators import fleets, hazards, news, tracks
from ..sources import records
from .news_queries import _CLASSES, items
from .shims import LAT_SQL, LON_SQL, POSITION_SQL, lat_of, lon_of, positions, table
from .signal_queries import _at, _pick, _q

FIRST = ("missile-strike-hits-border", "football-match-review", "protest-march-in-capital", "court-hears-terrorism-trial",
    "navy-drill-begins", "garden-show-opens", "hostage-freed-by-militia", "tanks-leave-base", "refugee-crisis-deepens")
SECOND = ("near-kyiv.html", "after-blast", "as-unrest-grows.php", "in-2024", "12345", "war-looms")
SITES = ("www.tass.example", "espn.com", "news.example", "www.wired.com", "daily.example")
LOCATIONS = ("Mali", "", "Kyiv, Ukraine", "Nowhere", "Sud")
COUNTRIES = (("Ukraine", 0, 49.0, 31.0), ("South Sudan", 1, 7.0, 30.0), ("Sudan", 2, 15.0, 30.0), ("Mali", 3, 17.0, -4.0),
    ("Maldives", 4, 3.2, 73.0))
TEXTS = ("", " 12 ", "1e3", "abc", "0x1F", "1f zz", "-0.0", "NaN", "0", "false", "12.5kg", "7")
ENVELOPES = ('[{n}, {m}]', '{{"markers": [{n}], "data": [1, 2]}}', '{{"events": [{n}, {m}, 3]}}', '{{"data": {{"x": 1}}}}', 'broken [',
    '{{"markers": [], "events": [{n}]}}', '{{"markers": null, "data": ["{n}"]}}')
AS_OF = "2023-12-31 12:00:00"


def _day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    url = F.concat(F.lit("https://"), _pick(SITES, k), F.lit("/"), (k % 3).cast("string"), F.lit("/"), _pick(FIRST, k), F.lit("-"),
        _pick(SECOND, k * 7 + 1))
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), k.alias("ord"), F.when(k % 29 != 0, url).alias("url"),
            F.when(k % 23 != 0, F.concat(F.lit("202401"), F.lpad((1 + k % 28).cast("string"), 2, "0"))).alias("date"),
            (3 + k % 2).cast("string").alias("quad_class"),
        F.lpad((12 + k % 9).cast("string"), 2, "0").alias("root"),
            F.when(k % 31 != 0, (k * 37 % 201) / F.lit(10.0) - F.lit(10.0)).alias("goldstein"),
            (2 + k % 4).cast("string").alias("geo_type"),
        _pick(LOCATIONS, k).alias("location"), F.when(k % 2 == 0, "Sudan").alias("country"), F.when(k % 6 != 0, lat_of(k)).alias("lat"),
            lon_of(k).alias("lon"),
    )


def day_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of at most 800 events of a day's map."""
    countries = spark.createDataFrame(COUNTRIES, "name string, ord int, lat double, lon double")
    out = rules.day_map(_day_events(spark, sf_dir), countries)
    score = F.floor(F.col("score") * 10 + 0.5).cast("long").alias("score")
    return out.select("id", "title", "domain", "category", "category_color", "color", score,
        *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("map_lat", "map_lon")))


def map_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the planetary index, the storm scales and quakes; quakes that are shown, with the radius of their mark."""
    k = F.col("o_orderkey")
    kp, level, alert = F.when(k % 11 != 0, k % 10), F.when(k % 7 != 0, k % 6), F.when(k % 3 == 0,
        F.element_at(F.array(*map(F.lit, ("red", "green", "none"))), (1 + k % 3).cast("int")))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), ((k % 90) / F.lit(10.0)).alias("mag"), hazards.kp_color(kp).alias("kp"),
        hazards.scale_color(level).alias("level"), alert.alias("alert"))
    return hazards.shown_quakes(rows).select("id", "radius", "kp", "level",
        hazards.quake_color(F.col("mag"), F.col("alert")).alias("quake"))


def map_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headlines each view of the map shows."""
    rows = news.classified(items(spark, sf_dir))
    each = [news.in_view(rows, v).agg(F.count("*").alias("n"), F.max("id").alias("last")).withColumn("view", F.lit(v))
        for v in ("air", "sea", "space", "osint", "all")]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def shown_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that the map shows, under the names of the feed."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 2 == 0, "air").otherwise("sea").alias("domain"),
            F.when(k % 5 != 0, _pick(("USA", "FRA", "USA"), k)).alias("country"),
            F.when(k % 4 != 0, F.when(k % 3 == 0, 100).otherwise(60)).alias("mil_score"),
        F.concat(F.lit("C"), k.cast("string")).alias("callsign"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), (k * 3).alias("alt_ft"),
            (k % 400).alias("speed"), (k % 360).alias("track"), F.lit("X").alias("type"),
        F.when(k % 8 == 0, "patrol").alias("activity"), F.when(k % 8 == 0, 0.5).alias("activity_confidence"),
    )
    return fleets.as_feed(fleets.shown_tracks(rows)).select("hex", "flight", "alt_baro", "gs", "t", "activity",
        F.floor(F.col("activity_confidence") * 10).cast("long").alias("sure"))


def enveloped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents in envelopes of several shapes."""
    k = F.col("o_orderkey")
    text = F.replace(F.replace(_pick(tuple(e.replace("{{", "{").replace("}}", "}") for e in ENVELOPES), k), F.lit("{n}"),
            k.cast("string")), F.lit("{m}"), (k + 1).cast("string"))
    docs = table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("json"))
    return records.enveloped(docs, ("markers", "events", "data"))


def vessel_events_of_90_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's page of at most 99 events that begin in the last 90 days."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("ord"),
        F.when(k % 9 != 0, F.timestamp_seconds(F.lit(1672531200) + (k * 7919 % 500) * 86400)).alias("start"))
    return hazards.vessel_events_in(rows, F.lit(AS_OF).cast("timestamp")).select("ord", "start")


def thinned_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 points of each entity without those within a step of the last kept one."""
    coarse = lambda c, by: (F.floor(F.col(c) / by) * by).alias(c)
    rows = tracks.last_points(positions(spark, sf_dir).select("entity", "seq", "ts_us", coarse("lat", 60), coarse("lon", 90)), 30)
    trail = rows.groupBy("entity").agg(F.sort_array(F.collect_list(
                F.struct((-F.col("back")).alias("at"), "seq", F.col("lat").cast("double").alias("lat"),
                    F.col("lon").cast("double").alias("lon")))).alias("t"))
    kept = tracks.thinned(F.col("t"))
    return trail.select("entity", F.size(kept).cast("long").alias("n"),
        F.array_join(F.transform(kept, lambda p: p["seq"].cast("string")), ",").alias("seqs"))


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, defaults and hexadecimal beginnings of texts, as lenient feeds give them."""
    k = F.col("o_orderkey")
    text = F.when(k % 13 != 12, _pick(TEXTS, k))
    number = numbers.lenient(text)
    told = F.when(F.isnan(number), "NaN").otherwise(F.floor(numbers.clamp(number, -5.0, 100.0) * 10).cast("long").cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), told.alias("number"), numbers.or_else(text, "other").alias("given"),
        numbers.hex_prefix(text).alias("hex"), numbers.half_up(numbers.places((k % 1000) / F.lit(8.0) - 60, 1) * 10).alias("tenths"))


QUERIES = {f.__name__: f for f in (day_map, map_colors, map_views, shown_tracks, enveloped_records, vessel_events_of_90_days,
        thinned_trails, lenient_numbers)}

_K = "o_orderkey"
_HAS = lambda text, words: "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s:/._-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_DAY = f"""ev AS (SELECT doc_id AS id, 'https://' || {_at(SITES, "doc_id")} || '/' || doc_id % 3 || '/' || {_at(FIRST, "doc_id")} || '-' || {_at(SECOND, "doc_id * 7 + 1")} AS url, regexp_replace({_at(SITES, "doc_id")}, '^www\\.', '') AS domain,
  replace(regexp_replace({_at(FIRST, "doc_id")} || '-' || {_at(SECOND, "doc_id * 7 + 1")}, '\\.(html|php)$', ''), '-', ' ') AS title, CASE WHEN doc_id % 23 <> 0 THEN '202401' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') ELSE '' END AS date,
  3 + doc_id % 2 AS quad, 12 + doc_id % 9 AS root, (doc_id * 37 % 201) / 10.0::DOUBLE - 10.0 AS g, coalesce(nullif({_at(LOCATIONS, "doc_id")}, ''), CASE WHEN doc_id % 2 = 0 THEN 'Sudan' END) AS place,
  CASE WHEN doc_id % 6 <> 0 THEN {LAT_SQL.format(k="doc_id")} END AS lat0, {LON_SQL.format(k="doc_id")} AS lon0 FROM documents WHERE doc_id % 29 <> 0 AND doc_id % 31 <> 0 AND 2 + doc_id % 4 >= 3),
c(name, ord, lat, lon) AS (VALUES {", ".join(f"('{n}', {o}, {a}::DOUBLE, {b}::DOUBLE)" for n, o, a, b in COUNTRIES)}),
m AS (SELECT ev.id, arg_min({{a: c.lat, o: c.lon}}, CASE WHEN lower(name) = lower(place) THEN ord ELSE 100 + ord END) AS spot FROM ev JOIN c ON lat0 IS NULL AND (contains(lower(name), lower(place)) OR contains(lower(place), lower(name))) GROUP BY ev.id),
p AS (SELECT ev.*, coalesce(lat0, spot.a) AS lat, CASE WHEN lat0 IS NULL THEN spot.o ELSE lon0 END AS lon FROM ev LEFT JOIN m USING (id)
  WHERE ((quad = 4 AND root BETWEEN 13 AND 20 AND g <= -1) OR (quad = 3 AND root IN (13, 15, 17, 18, 19, 20) AND g <= -5)) AND (lat0 IS NOT NULL OR spot IS NOT NULL)),
s AS (SELECT *, {_PLAIN.format("title || ' ' || url || ' ' || domain")} AS t, {_PLAIN.format("title || ' ' || url")} AS u FROM p),
sc AS (SELECT *, abs(g) * 10 + {" + ".join(f"CASE WHEN contains(t, {_q(w)}) THEN {rules.POINTS.get(w, 20)} ELSE 0 END" for w in rules.OPERATIONAL)} AS score FROM s),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, date DESC, id) = 1),
top AS (SELECT * FROM b WHERE domain NOT IN ({", ".join(map(_q, rules.NOISE_HOSTS))}) AND NOT {_HAS("t", rules.NOISE)} AND {_HAS("t", rules.OPERATIONAL)} ORDER BY score DESC, abs(g) DESC, date DESC, id LIMIT 800)"""
_CASES = lambda i: "CASE " + " ".join(f"WHEN {_HAS('u', c[2])} THEN '{c[i]}'" for c in rules.CATEGORIES)
_DRAWN = "(('0x' || md5('{}' || id)[1:8])::BIGINT / 4294967296.0::DOUBLE - 0.5) * 0.5"
# what each text is as a number (tenths, within bounds), a given value and a hexadecimal beginning
_NUMBERS = (("0", "other", None), ("120", " 12 ", 18), ("1000", "1e3", 483), ("NaN", "abc", 2748), ("NaN", "0x1F", 31),
    ("NaN", "1f zz", 31), ("0", "other", None), ("NaN", "other", None), ("0", "other", 0), ("NaN", "other", 250), ("NaN", "12.5kg", 18),
    ("70", "7", 7))


def _nth(i: int) -> str:
    return f"CASE WHEN {_K} % 13 <> 12 THEN CASE {_K} % {len(_NUMBERS)} " + " ".join(f"WHEN {n} THEN {v if isinstance(v, int) else _q(v)}"
        for n, v in enumerate(x[i] for x in _NUMBERS) if v is not None) + " END END"


SQL = {
    "day_map": f"""WITH {_DAY} SELECT id, title, domain, {_CASES(0)} ELSE 'incident' END AS category, {_CASES(1)} ELSE '#4a6a7a' END AS category_color,
  CASE WHEN g <= -7 THEN '#ff2244' WHEN g <= -5 THEN '#ff5533' WHEN g < -2 THEN '#ffaa00' WHEN g < 0 THEN '#ffdd55' ELSE '#00d4ff' END AS color, floor(score * 10 + 0.5)::BIGINT AS score,
  floor((lat + {_DRAWN.format("a")}) * 1000 + 0.5)::BIGINT AS map_lat, floor((lon + {_DRAWN.format("o")}) * 1000 + 0.5)::BIGINT AS map_lon FROM top""",
    "map_colors": f"""WITH q AS (SELECT {_K} AS id, ({_K} % 90) / 10.0::DOUBLE AS mag, CASE WHEN {_K} % 11 <> 0 THEN {_K} % 10 END AS kp, CASE WHEN {_K} % 7 <> 0 THEN {_K} % 6 ELSE 0 END AS lv, CASE WHEN {_K} % 3 = 0 THEN 'red' END AS alert FROM orders)
SELECT id, CASE WHEN mag >= 7.5 THEN 22 WHEN mag >= 6.5 THEN 14 ELSE 8 END AS radius, CASE WHEN kp IS NULL THEN '#2a4a5a' WHEN kp >= 7 THEN '#ff2244' WHEN kp >= 5 THEN '#ff6600' WHEN kp >= 4 THEN '#ffaa00' WHEN kp >= 3 THEN '#ffdd55' ELSE '#00ff88' END AS kp,
  CASE WHEN lv >= 4 THEN '#ff2244' WHEN lv = 3 THEN '#ff6600' WHEN lv = 2 THEN '#ffaa00' WHEN lv = 1 THEN '#ffdd55' ELSE '#2a4a5a' END AS level,
  CASE WHEN alert = 'red' OR mag >= 7 THEN '#ff2244' WHEN mag >= 6 THEN '#ff6600' ELSE '#ffaa00' END AS quake FROM q WHERE mag >= 5.5""",
    "map_views": f"""WITH {_CLASSES}, v(view, sees) AS (VALUES ('air', ['aviation']), ('sea', ['naval']), ('space', ['spatial']), ('osint', ['missile', 'military']), ('all', ['aviation', 'naval', 'spatial', 'missile', 'military']))
SELECT view, count(id) AS n, max(id) AS last FROM v LEFT JOIN classes ON list_contains(sees, domain) GROUP BY view""",
    "shown_tracks": """WITH t AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS air, c_custkey % 5 <> 0 AND c_custkey % 3 <> 1 AS usa, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 60 END END, 0) AS s FROM customer)
SELECT k AS hex, 'C' || k AS flight, k * 3 AS alt_baro, k % 400 AS gs, 'X' AS t, CASE WHEN k % 8 = 0 THEN 'patrol' END AS activity, CASE WHEN k % 8 = 0 THEN 5 ELSE 0 END AS sure FROM t WHERE NOT (air AND usa AND s <> 100)""",
    "enveloped_records": f"""WITH k AS (SELECT {_K} AS id, CASE {_K} % 7 WHEN 0 THEN [{_K}::VARCHAR, ({_K} + 1)::VARCHAR] WHEN 1 THEN [{_K}::VARCHAR] WHEN 2 THEN [{_K}::VARCHAR, ({_K} + 1)::VARCHAR, '3'] WHEN 6 THEN ['"' || {_K} || '"'] ELSE [] END AS e FROM orders)
SELECT id, generate_subscripts(e, 1) - 1 AS ord, unnest(e) AS entry FROM k""",
    "vessel_events_of_90_days": f"""WITH r AS (SELECT {_K} AS ord, make_timestamp((1672531200 + ({_K} * 7919 % 500) * 86400) * 1000000) AS start FROM orders WHERE {_K} % 9 <> 0)
SELECT * FROM r WHERE start::DATE BETWEEN DATE '2023-12-31' - 90 AND DATE '2023-12-31' ORDER BY start DESC, ord LIMIT 99""",
    "thinned_trails": f"""WITH RECURSIVE r AS (SELECT entity, seq, floor(lat / 60) * 60 AS lat, floor(lon / 90) * 90 AS lon, row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, seq DESC) AS back FROM {POSITION_SQL} QUALIFY back <= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY back DESC) AS n FROM r),
w(entity, n, lat, lon, seqs) AS (SELECT entity, n, lat, lon, [seq] FROM o WHERE n = 1 UNION ALL SELECT o.entity, o.n, CASE WHEN far THEN o.lat ELSE w.lat END, CASE WHEN far THEN o.lon ELSE w.lon END, CASE WHEN far THEN list_append(seqs, seq) ELSE seqs END
  FROM w JOIN (SELECT * FROM o) o ON o.entity = w.entity AND o.n = w.n + 1, LATERAL (SELECT abs(o.lat - w.lat) >= 0.001 OR abs(o.lon - w.lon) >= 0.001 AS far))
SELECT entity, len(seqs) AS n, array_to_string(seqs, ',') AS seqs FROM w QUALIFY row_number() OVER (PARTITION BY entity ORDER BY w.n DESC) = 1""",
    "lenient_numbers": f"""SELECT {_K} AS id, {_nth(0)} AS number, coalesce({_nth(1)}, 'other') AS given, {_nth(2)} AS hex,
  floor(floor((({_K} % 1000) / 8.0::DOUBLE - 60) * 10 + 0.5) / 10 * 10 + 0.5)::BIGINT AS tenths FROM orders""",
}
