"""Queries over maritime, aviation and spatial signals, made from short reports that the test tables number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals
from .shims import COUNTRIES, LAT_SQL, LON_SQL, POSITION_SQL, km_sql, lat_of, lon_of, positions, table

#: Beginnings, middles and ends that the reports' titles are put together from.
SUBJECTS = ("Navy frigate", "Fighter jets", "Spy satellite", "Fishing boats", "F-35 squadron", "Cosmos 2251", "Russian navy tanker",
    "Opinion column", "Drone swarm", "Coast guard carrier", "GPS jamming", "Farmers", "Warship task force")
MIDDLES = ("intercepted", "scrambled over the airspace near", "launched a rocket and satellite at", "deployed with the fleet to",
    "struck and hit the target in", "held a naval exercise off", "jammed the signal over", "boarded and seized a ship in", "talked in",
    "reentered over", "shot down a drone over")
ENDS = ("the Red Sea", "Hormuz strait", "low orbit", "the capital", "a port visit", "the Taiwan Strait, analysis says", "years ago",
    "an air base", "the harbour forecast", "the telescope science mission")
ACTORS = ("", "Pacific Fleet", "Coast Guard", "AIR FORCE", "Space Command")
SUBS = ("naval blockade", "", "Use force", "military exercise")
CATEGORIES = ("military", "strategic", "conflict", "crisis", "incident", "protest")
KINDS = ("base", "chokepoint", "port", "zone", "lane")
NAMES = ("COSMOS", "STARLINK", "SHIP A", "FLEET-1", "ASAT")


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short reports from ``documents``: every title is one beginning, middle and end."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat_ws(" ", _pick(SUBJECTS, k), _pick(MIDDLES, k * 5 + 1), _pick(ENDS, k * 3 + 2)).alias("title"),
            _pick(ACTORS, k).alias("actor1"),
        F.lit(None).cast("string").alias("actor2"), _pick(SUBS, k).alias("sub_type"), _pick(CATEGORIES, k * 7).alias("category"),
        F.when(k % 9 == 0, "maritime").otherwise("general").alias("bucket"), _pick(COUNTRIES, k).alias("country"),
            F.lit("x.example").alias("domain"),
        F.lit(None).cast("string").alias("url"), F.when(k % 50 != 49, lat_of(k)).alias("lat"), lon_of(k).alias("lon"),
            F.when(k % 31 != 30, (k % 60).cast("double")).alias("age_h"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _pick(KINDS, k).alias("kind"), k.alias("site"), lat_of(k * 3).alias("site_lat"), lon_of(k * 3).alias("site_lon"),
        F.when(k % 5 == 3, (k % 9 * 100 + 150).cast("double")).alias("radius_km"), k.alias("ord"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.when(k % 6 != 5, F.concat_ws(" ", _pick(NAMES, k), k.cast("string"))).alias("name"),
        (k % 40 == 0).alias("high_interest"))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("anomaly"), lat_of(k * 11).alias("site_lat"), lon_of(k * 11).alias("site_lon"), (k % 101).alias("anomaly_confidence"),
            (k % 2 == 0).alias("anomaly_sensitive"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"),
    )


_TAGS = lambda c: F.array_join(c, ";")


def _maritime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.maritime_signals(reports(spark, sf_dir), places(spark, sf_dir), widest_zone=950.0)


def maritime_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _maritime(spark, sf_dir)
    return out.select("id", "type", _TAGS("tags").alias("tags"), "maritime_score", "keyword_score", "verb_score", "penalty", "geo_score",
        "confidence", "reality", _TAGS(signals.context_tags()).alias("context"), "base", "base_km", "zone")


def aviation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = places(spark, sf_dir).where("kind = 'base'").select("site", "site_lat", "site_lon")
    seen = positions(spark, sf_dir).select(F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    out = signals.aviation_signals(reports(spark, sf_dir), bases, seen)
    return out.select("id", "type", _TAGS("tags").alias("tags"), "keyword_score", "verb_score", "penalty", "geo_score", "recency",
        "n_observed", "status", "confidence", "reality", "class")


def spatial_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.spatial_signals(reports(spark, sf_dir), objects(spark, sf_dir))
    told = signals.description(F.col("type"), F.col("title"))
    return out.select("id", "type", _TAGS("tags").alias("tags"), "keyword_score", "verb_score", "penalty", "recency", "status",
        "confidence", "reality", "class", told.alias("description"))


def naval_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.naval_activity(_maritime(spark, sf_dir), anomalies(spark, sf_dir))
    return out.select("id", "anomaly_bonus", "recency_penalty", "boosted", "class",
        F.coalesce(F.array_join(F.transform("near", lambda x: x["anomaly"].cast("string")), ";"), F.lit("")).alias("near"))


def anomaly_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies with the places around them."""
    rows = anomalies(spark, sf_dir).select("anomaly", F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    out = signals.context(rows, places(spark, sf_dir), "anomaly", 950.0)
    return out.select("anomaly", "base", "chokepoint", "port", "lane", "zone", "zone_km", "sensitive",
        _TAGS(signals.context_tags()).alias("context"))


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each kind of signal in each report, heaviest first, and the labels of what speaks against it."""
    t = F.lower("title")
    rows = reports(spark, sf_dir)
    return rows.select("id", *(_TAGS(signals.matched_terms(t, d.weights)).alias(d.name)
            for d in (signals.MARITIME, signals.AVIATION, signals.SPATIAL)),
        _TAGS(signals.penalty_labels(t, signals.AVIATION.penalties)).alias("labels"))


QUERIES = {f.__name__: f for f in (maritime_signals, aviation_signals, spatial_signals, naval_activity, anomaly_context, matched_terms)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _at(values: tuple[str, ...], k: str) -> str:
    return f"([{', '.join(map(_q, values))}])[1 + ({k}) % {len(values)}]"


REPORT_SQL = f"""(SELECT doc_id AS id, {_at(SUBJECTS, "doc_id")} || ' ' || {_at(MIDDLES, "doc_id * 5 + 1")} || ' ' || {_at(ENDS, "doc_id * 3 + 2")} AS title,
  {_at(ACTORS, "doc_id")} AS actor1, {_at(SUBS, "doc_id")} AS sub_type, {_at(CATEGORIES, "doc_id * 7")} AS category, CASE WHEN doc_id % 9 = 0 THEN 'maritime' ELSE 'general' END AS bucket,
  {_at(COUNTRIES, "doc_id")} AS country, CASE WHEN doc_id % 50 <> 49 THEN {LAT_SQL.format(k="doc_id")} END AS lat, {LON_SQL.format(k="doc_id")} AS lon,
  CASE WHEN doc_id % 31 <> 30 THEN (doc_id % 60)::DOUBLE END AS age_h FROM documents)"""
PLACE_SQL = f"""(SELECT {_at(KINDS, "s_suppkey")} AS kind, s_suppkey AS site, {LAT_SQL.format(k="s_suppkey * 3")} AS site_lat, {LON_SQL.format(k="s_suppkey * 3")} AS site_lon,
  CASE s_suppkey % 5 WHEN 0 THEN 450 WHEN 1 THEN 300 WHEN 2 THEN 175 WHEN 4 THEN 320 ELSE s_suppkey % 9 * 100 + 150 END AS radius FROM supplier)"""
ANOMALY_SQL = f"""(SELECT c_custkey AS anomaly, {LAT_SQL.format(k="c_custkey * 11")} AS lat, {LON_SQL.format(k="c_custkey * 11")} AS lon, c_custkey % 101 AS sure, c_custkey % 2 = 0 AS sens FROM customer)"""
_BLOB = "lower(concat_ws(' ', title, nullif(actor1, ''), nullif(sub_type, ''), category{bucket}, country, 'x.example'))"


def _matches(pattern: str) -> str:
    """A pattern on ``blob``; RE2 has no look-ahead, so the one that needs it is stated apart."""
    ahead = r"\bcommunications satellite\b(?!.*military)"
    rest = pattern.replace("|" + ahead, "")
    own = f"regexp_matches(blob, {_q(rest)})"
    return own if rest == pattern else rf"({own} OR (regexp_matches(blob, '\bcommunications satellite\b') AND NOT regexp_matches(blob, '\bcommunications satellite\b.*military')))"


def _scores_sql(d: signals.Domain, bucket: str = "") -> str:
    keywords = " + ".join(f"CASE WHEN contains(blob, {_q(t)}) THEN {w} ELSE 0 END" for t, w in d.weights.items())
    verbs = " + ".join(f"CASE WHEN {_matches(p)} THEN {n} ELSE 0 END" for p, n in d.verbs)
    minus = " + ".join(f"CASE WHEN {_matches(p)} THEN {n} ELSE 0 END" for p, n, _ in d.penalties)
    hit = lambda terms: "(" + " OR ".join(f"contains(blob, {_q(t)})" for t in terms) + ")"
    heaviest = sorted((x for x in d.types if x[1] > d.default[1]), key=lambda x: -x[1])
    pick = lambda value: "CASE " + " ".join(f"WHEN {hit(terms)} THEN {value(n, w)}" for n, w,
        terms in heaviest) + f" ELSE {value(*d.default)} END"
    tags = ", ".join(f"CASE WHEN {hit(terms)} THEN '{n}' END" for n, _, terms in d.types)
    boost = "CASE category " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in d.boosts.items()) + f" ELSE {d.other_boost} END"
    return f"""texts AS (SELECT *, {_BLOB.format(bucket=bucket)} AS blob FROM {REPORT_SQL} WHERE lat IS NOT NULL),
scores AS (SELECT *, {keywords} AS keyword_score, least(32, {verbs}) AS verb_score, least(40, {minus}) AS penalty, {pick(lambda n, w: f"'{n}'")} AS type, {pick(lambda n, w: str(w))} AS type_weight,
  [{tags}] AS hits, {boost} AS category_boost FROM texts)"""


_SQL_TAGS = "array_to_string(list_filter(hits, lambda x: x IS NOT NULL AND x <> type), ';') AS tags"


def _context_sql(rows: str, key: str) -> str:
    km = km_sql("r.lat", "r.lon", "p.site_lat", "p.site_lon")
    near = ", ".join(f"arg_min(site, {{k: km, s: site}}) FILTER (kind = '{k}') AS {k}, floor(min(km) FILTER (kind = '{k}') + 0.5)::BIGINT AS {k}_km"
        for k in KINDS if k != "zone")
    return f"""pairs AS (SELECT * FROM (SELECT r.{key}, p.kind, p.site, p.radius, {km} AS km FROM {rows} r, {PLACE_SQL} p) WHERE km <= radius),
near AS (SELECT {key}, {near}, min(site) FILTER (kind = 'zone') AS zone, floor(arg_min(km, site) FILTER (kind = 'zone') + 0.5)::BIGINT AS zone_km FROM pairs GROUP BY {key})"""


_CONTEXT_TAGS = "concat_ws(';', CASE WHEN base IS NOT NULL THEN 'near_naval_base' END, CASE WHEN chokepoint IS NOT NULL THEN 'near_chokepoint' END, CASE WHEN port IS NOT NULL THEN 'near_major_port' END, CASE WHEN zone IS NOT NULL THEN 'inside_strategic_zone' END, CASE WHEN lane IS NOT NULL THEN 'near_major_sea_lane' END)"
_SENSITIVE = "(base IS NOT NULL OR chokepoint IS NOT NULL OR zone IS NOT NULL)"
_REALITY = "CASE WHEN penalty >= 20 AND NOT (verb_score >= 10 OR keyword_score >= 22) THEN 'topic' WHEN {c} THEN 'corroborated_activity' WHEN verb_score >= 10 OR keyword_score >= 22 THEN 'operational_signal' ELSE 'topic' END"
_MARITIME = f"""WITH {_scores_sql(signals.MARITIME, ", bucket")},
boosted AS (SELECT *, CASE WHEN regexp_matches(coalesce(actor1, ''), '(?i)navy|fleet|maritime|coast guard|destroyer|frigate|submarine') THEN 8 ELSE 0 END AS actor_boost,
  CASE WHEN regexp_matches(coalesce(sub_type, ''), '(?i)naval|maritime|blockade|exercise|deployment|intercept') THEN 6 ELSE 0 END AS sub_boost, CASE WHEN bucket = 'maritime' THEN 16 ELSE 0 END AS backend,
  CASE WHEN regexp_matches(blob, 'red sea|hormuz|bab el mandeb|suez|taiwan strait|south china sea|black sea|baltic sea') THEN 8 ELSE 0 END AS zone_boost FROM scores),
summed AS (SELECT *, keyword_score + category_boost + actor_boost + sub_boost + backend + zone_boost AS maritime_score FROM boosted),
{_context_sql("summed", "id")},
passed AS (SELECT *, CASE WHEN base IS NOT NULL THEN 18 ELSE 0 END + CASE WHEN chokepoint IS NOT NULL THEN 16 ELSE 0 END + CASE WHEN port IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN zone IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN lane IS NOT NULL THEN 6 ELSE 0 END AS geo_score
  FROM summed LEFT JOIN near USING (id)
  WHERE (maritime_score >= 22 OR (backend > 0 AND (chokepoint IS NOT NULL OR zone IS NOT NULL OR lane IS NOT NULL) AND maritime_score >= 18)) AND (keyword_score > 0 OR {_SENSITIVE})),
sig AS (SELECT *, greatest(0, least(100, keyword_score + type_weight + verb_score + category_boost + actor_boost + sub_boost + geo_score - penalty)) AS confidence FROM passed)"""

SQL = {
    "maritime_signals": f"{_MARITIME} SELECT id, type, {_SQL_TAGS}, maritime_score, keyword_score, verb_score, penalty, geo_score, confidence, {_REALITY.format(c='false')} AS reality, {_CONTEXT_TAGS} AS context, base, base_km, zone FROM sig",
    "aviation_signals": f"""WITH {_scores_sql(signals.AVIATION)},
kept AS (SELECT * FROM scores WHERE keyword_score >= 22),
bases AS (SELECT id, floor(min(km) + 0.5)::BIGINT AS base_km FROM (SELECT r.id, {km_sql("r.lat", "r.lon", "p.site_lat", "p.site_lon")} AS km FROM kept r, {PLACE_SQL} p WHERE kind = 'base') WHERE km <= 400 GROUP BY id),
seen AS (SELECT id, count(*) AS n FROM (SELECT r.id, {km_sql("r.lat", "r.lon", "o.lat", "o.lon")} AS km FROM kept r, {POSITION_SQL} o) WHERE km <= 250 GROUP BY id),
parts AS (SELECT kept.*, coalesce(n, 0) AS n_observed, CASE WHEN base_km < 100 THEN 18 WHEN base_km < 200 THEN 12 WHEN base_km < 400 THEN 6 ELSE 0 END AS geo_score,
  CASE WHEN age_h <= 6 THEN 8 WHEN age_h <= 24 THEN 4 ELSE 0 END AS recency, CASE WHEN n > 0 THEN 8 ELSE 0 END AS corroboration FROM kept LEFT JOIN bases USING (id) LEFT JOIN seen USING (id)),
sig AS (SELECT *, greatest(0, least(100, keyword_score + type_weight + verb_score + category_boost + geo_score + recency + corroboration - penalty)) AS confidence FROM parts)
SELECT id, type, {_SQL_TAGS}, keyword_score, verb_score, penalty, geo_score, recency, n_observed, CASE WHEN n_observed > 0 THEN 'matched' ELSE 'not_found' END AS status, confidence, {_REALITY.format(c="corroboration > 0")} AS reality,
  CASE WHEN confidence >= 75 THEN 'probable_air_activity' WHEN confidence >= 50 THEN 'possible_air_activity' ELSE 'weak_signal' END AS class FROM sig""",
    "spatial_signals": f"""WITH {_scores_sql(signals.SPATIAL)},
kept AS (SELECT * FROM scores WHERE keyword_score >= 20),
objects AS (SELECT lower({_at(NAMES, "s_suppkey")} || ' ' || s_suppkey) AS name FROM supplier WHERE s_suppkey % 6 <> 5),
high AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 40 = 0),
parts AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM objects WHERE contains(kept.blob, substr(name, 1, 6))) THEN 'matched' WHEN (SELECT n FROM high) > 0 THEN 'high_interest_tip' ELSE 'not_found' END AS status,
  CASE WHEN age_h <= 6 THEN 10 WHEN age_h <= 24 THEN 5 ELSE 0 END AS recency FROM kept),
sig AS (SELECT *, CASE status WHEN 'matched' THEN 14 WHEN 'high_interest_tip' THEN 6 ELSE 0 END AS corroboration,
  greatest(0, least(100, keyword_score + type_weight + verb_score + category_boost + recency + CASE status WHEN 'matched' THEN 14 WHEN 'high_interest_tip' THEN 6 ELSE 0 END - penalty)) AS confidence FROM parts)
SELECT id, type, {_SQL_TAGS}, keyword_score, verb_score, penalty, recency, status, confidence, {_REALITY.format(c="corroboration > 0")} AS reality,
  CASE WHEN confidence >= 75 THEN 'probable_space_activity' WHEN confidence >= 50 THEN 'possible_space_activity' ELSE 'weak_signal' END AS class, substr(replace(type, '_', ' ') || ' — ' || title, 1, 280) AS description FROM sig""",
    "naval_activity": f"""{_MARITIME},
near_anomalies AS (SELECT *, floor(18 * (1 - km / 220.0::DOUBLE) * (CASE WHEN sure = 0 THEN 50 ELSE sure END) / 100 * CASE WHEN sens THEN 1.15::DOUBLE ELSE 1.0 END + 0.5)::BIGINT AS bonus
  FROM (SELECT s.id, a.*, {km_sql("s.lat", "s.lon", "a.lat", "a.lon")} AS km FROM sig s, {ANOMALY_SQL} a) WHERE km <= 220),
best AS (SELECT id, anomaly, bonus, row_number() OVER (PARTITION BY id ORDER BY bonus DESC, floor(km + 0.5), anomaly) AS r FROM near_anomalies WHERE bonus > 0 QUALIFY r <= 3),
told AS (SELECT id, sum(bonus)::BIGINT AS anomaly_bonus, string_agg(anomaly::VARCHAR, ';' ORDER BY r) AS near FROM best GROUP BY id),
out AS (SELECT sig.id, coalesce(anomaly_bonus, 0) AS anomaly_bonus, CASE WHEN age_h IS NULL OR age_h <= 6 THEN 0 ELSE least(24, floor(10 * log2(1 + age_h / 36) + 0.5)) END::BIGINT AS recency_penalty, confidence, coalesce(near, '') AS near FROM sig LEFT JOIN told ON told.id = sig.id),
final AS (SELECT *, greatest(0, least(100, confidence + anomaly_bonus - recency_penalty)) AS boosted FROM out)
SELECT id, anomaly_bonus, recency_penalty, boosted, CASE WHEN boosted >= 75 THEN 'probable_naval_activity' WHEN boosted >= 55 THEN 'possible_naval_activity' ELSE 'weak_signal' END AS class, near FROM final""",
    "anomaly_context": f"WITH {_context_sql(ANOMALY_SQL, 'anomaly')} SELECT anomaly, base, chokepoint, port, lane, zone, zone_km, {_SENSITIVE} AS sensitive, {_CONTEXT_TAGS} AS context FROM {ANOMALY_SQL} LEFT JOIN near USING (anomaly)",
    "matched_terms": "SELECT id, "
    + ", ".join("concat_ws(';', " + ", ".join(f"CASE WHEN contains(lower(title), {_q(t)}) THEN {_q(t)} END"
            for t in sorted(d.weights, key=lambda t, d=d: -d.weights[t])) + f") AS {d.name}"
        for d in (signals.MARITIME, signals.AVIATION, signals.SPATIAL))
    + ", concat_ws(';', " + ", ".join(f"CASE WHEN {_matches(p).replace('blob', 'lower(title)')} THEN '{n}' END" for p, _,
            n in signals.AVIATION.penalties) + f") AS labels FROM {REPORT_SQL}",
}
