"""Queries over curated events: scoring, selection, duplicates and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import region_for_quota, region_on_map
from ..functions.text import keyword_patterns, word_set
from ..operators import rollups, scoring, selection, similarity
from .shims import EVENT_SQL, MENTION_SQL, events, mentions

#: Words that stand in the invented prose of the test tables.
WORDS = scoring.Lexicons(military=("this", "with", "from", "dans", "nicht", "para"), civilian=("worthless", "moron", "are"),
    calming=("that the", "pour"))
MOST = 600


def _hits_sql(words: tuple[str, ...]) -> str:
    def one(word: str) -> str:
        pattern = next(p for p in keyword_patterns([word]) if p).replace("'", "''")
        return f"regexp_matches(lower(title), '{pattern}')::INT"

    return "(" + " + ".join(map(one, words)) + ")"


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(events(spark, sf_dir), WORDS)


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_FORCE, _PRESSURE, _CODES, _ROOTS = (_IN(x) for x in (scoring.FORCE_ROOTS, scoring.PRESSURE_ROOTS, scoring.STRUCTURAL_CODES,
        scoring.STRUCTURAL_ROOTS))
_HOT, _BOOSTED = _IN(scoring.HOTSPOTS), _IN(scoring.BOOSTED_REGIONS)
_BOX = lambda s, n, w, e: f"lat > {s} AND lat < {n} AND lon > {w} AND lon < {e}"
REGION_SQL = f"""CASE WHEN {_BOX(34, 72, -25, 45)} THEN CASE WHEN country IN ('RU','UA','AM','AZ','GE','KG','KZ','MD','BY') THEN 'russia_cis'
    WHEN country = 'FR' AND {_BOX(41, 51.5, -5.5, 10)} THEN 'france' ELSE 'europe' END
  WHEN {_BOX(12, 43, 25, 65)} THEN 'middleeast' WHEN {_BOX(-12, 55, 95, 150)} THEN 'east_asia' WHEN {_BOX(0, 40, 60, 95)} THEN 'south_asia'
  WHEN {_BOX(-35, 38, -20, 55)} THEN 'africa' WHEN {_BOX(-60, 15, -90, -30)} THEN 'south_america' WHEN lat > 15 AND lon > -170 AND lon < -50 THEN 'north_america'
  WHEN lat < -10 AND lon > 110 AND lon < 180 THEN 'oceania' WHEN country = 'FR' THEN 'france' WHEN country IN ('CN','KP','KR','TW','VN') THEN 'east_asia'
  WHEN country IN ('AF','PK','IN','BD') THEN 'south_asia' WHEN country IN ('BR','AR','CL','CO','PE','VE') THEN 'south_america' ELSE 'other' END"""
QUOTA_REGION_SQL = f"""CASE WHEN country = 'FR' THEN 'france' WHEN country IN ('RS','UP') THEN 'russia_ukraine'
  WHEN country IN ('CH','TW','KN','KS','JA','VM') OR ({_BOX(15, 55, 95, 150)}) THEN 'east_asia'
  WHEN country IN ('IN','PK','AF','BG','NP','CE','KZ','KG','TI','TX','UZ') OR (lat > 5 AND lat < 55 AND lon > 60 AND lon <= 95) THEN 'south_central_asia'
  WHEN country IN ('IR','IZ','IS','WE','GZ','JO','LE','SY','SA','YM','AE','QA','KU','BA','MU','TU') OR ({_BOX(12, 43, 25, 65)}) THEN 'middle_east'
  WHEN {_BOX(-35, 38, -20, 55)} THEN 'africa' WHEN {_BOX(-60, 15, -90, -30)} THEN 'south_america'
  WHEN lat >= 15 AND lat < 75 AND lon > -170 AND lon < -50 THEN 'north_america' WHEN {_BOX(-50, 5, 110, 180)} THEN 'oceania'
  WHEN {_BOX(34, 72, -25, 45)} THEN 'europe' ELSE 'other' END"""
MAP_REGION_SQL = f"""CASE WHEN {_BOX(34, 72, -25, 45)} THEN 'europe' WHEN {_BOX(12, 43, 25, 65)} THEN 'middleeast' WHEN {_BOX(-12, 55, 60, 150)} THEN 'asia'
  WHEN {_BOX(-35, 38, -20, 55)} THEN 'africa' WHEN lon > -170 AND lon < -30 THEN 'americas' ELSE 'oceania' END"""
SCORED_SQL = f"""
flagged AS (SELECT *, {_hits_sql(WORDS.military)} AS military_hits, {_hits_sql(WORDS.civilian)} > 0 AS civilian, {_hits_sql(WORDS.calming)} > 0 AS calming FROM {EVENT_SQL}),
placed AS (SELECT *, military_hits >= 1 AS military, military_hits >= 2 AS strong, {REGION_SQL} AS region FROM flagged),
kinds AS (SELECT *,
  CASE WHEN tone <= -7 THEN 'CRITICAL' WHEN tone <= -5 THEN 'SEVERE' WHEN tone <= -2 THEN 'HIGH' WHEN tone < 0 THEN 'MODERATE' ELSE 'LOW' END AS severity,
  CASE WHEN civilian AND NOT military THEN 'discard' WHEN code LIKE '155%' THEN 'cyber' WHEN code LIKE '1831%' OR code LIKE '1832%' OR code LIKE '1833%' THEN 'terrorism'
    WHEN code LIKE '181%' THEN CASE WHEN military THEN 'terrorism' ELSE 'discard' END
    WHEN root IN {_FORCE} THEN CASE WHEN military THEN 'conflict' ELSE 'incident' END
    WHEN root = '15' THEN CASE WHEN military THEN 'military' ELSE 'incident' END WHEN root = '14' THEN 'protest'
    WHEN root IN {_PRESSURE} THEN CASE WHEN military THEN 'strategic' ELSE 'incident' END ELSE 'discard' END AS category,
  floor(CASE WHEN code IN {_CODES} THEN 44 WHEN root IN {_FORCE} THEN 38 WHEN root = '15' THEN 34 WHEN root = '14' THEN 20 WHEN root IN {_PRESSURE} THEN 24 ELSE 10 END
    + least(24.0::DOUBLE, abs(tone) * 4) + least(12.0::DOUBLE, ln(1 + coalesce(sources, 0)) * 4) + least(12.0::DOUBLE, ln(1 + coalesce(articles, 0)) * 4) + least(14.0::DOUBLE, ln(1 + coalesce(mentions, 0)) * 5)
    + CASE WHEN age_h IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, 16 - least(16.0::DOUBLE, age_h)) END + CASE geo_type WHEN 4 THEN 12 WHEN 3 THEN 8 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END
    + CASE WHEN strong THEN 12 WHEN military THEN 5 ELSE 0 END + CASE WHEN country IN {_HOT} THEN 18 ELSE 0 END + CASE WHEN region IN {_BOOSTED} THEN 8 ELSE 0 END
    - CASE WHEN civilian THEN 45 ELSE 0 END - CASE WHEN calming THEN 20 ELSE 0 END - CASE WHEN NOT military AND root IN {_FORCE} THEN 18 ELSE 0 END + 0.5)::BIGINT AS score
  FROM placed),
kept AS (SELECT *,
  CASE WHEN code IN {_CODES} THEN true WHEN civilian AND NOT strong THEN false WHEN strong THEN true WHEN military AND (root IN {_ROOTS} OR sources >= 3) THEN true
    WHEN root NOT IN {_ROOTS} THEN false WHEN root IN ('18','19','20','14','15') THEN sources >= 2 ELSE sources >= 3 END AS keep,
  code IN {_CODES} OR (root IN {_FORCE} AND tone <= -8) OR tone <= -9.5 OR (score >= 130 AND country IN {_HOT}) OR score >= 150 AS strategic FROM kinds),
scored AS (SELECT *, CASE WHEN category = 'discard' OR NOT keep THEN false WHEN sources < 2 AND NOT strategic AND score < 80 THEN false WHEN score >= 60 THEN true
  WHEN category = 'military' AND military AND sources >= 2 AND score >= 52 THEN true WHEN strategic AND score >= 52 THEN true
  ELSE category = 'conflict' AND sources >= 2 AND score >= 54 END AS relevant FROM kept)"""


def _order():
    """Best first; unknown coverage counts as none."""
    known = [F.desc(F.coalesce(c, F.lit(0))) for c in ("sources", "articles", "mentions")]
    return [F.desc("score"), *known, F.col("id")]


_ORDER_SQL = "score DESC, sources DESC, articles DESC, mentions DESC, id"


def a_curated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: mentions joined, events scored and filtered, duplicates by title removed, quotas by region filled."""
    summary = rollups.mention_summary(mentions(spark, sf_dir)).select(F.col("event_id").alias("id"), "mention_count")
    rows = events(spark, sf_dir).join(summary, "id", "left").withColumn("mentions", F.coalesce("mention_count", "mentions", F.lit(0)))
    rows = scoring.scored(rows, WORDS).where("relevant")
    unique = selection.keep_one(rows, ["title"], *_order()).withColumn("quota_region",
        region_for_quota(*map(F.col, ("lat", "lon", "country")), F.lit("")))
    chosen = selection.quota_select(unique, "quota_region", selection.QUOTAS, MOST, *_order())
    return chosen.select("id", "title", "category", "region", "quota_region", "severity", "score", "strategic", "mentions")


_QUOTAS_SQL = ", ".join(f"('{g}', {q}, {i})" for i, (g, q) in enumerate(selection.QUOTAS))


def _quota_sql(source: str, group: str, columns: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {_ORDER_SQL}) AS r FROM {source}),
quotas(g, q, i) AS (VALUES {_QUOTAS_SQL}),
first_pass AS (SELECT ranked.* FROM ranked JOIN quotas ON g = {group} WHERE r <= q ORDER BY i, r LIMIT {MOST}),
second_pass AS (SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS n FROM ranked WHERE id NOT IN (SELECT id FROM first_pass))
SELECT {columns} FROM first_pass UNION ALL SELECT {columns} FROM second_pass WHERE n <= {MOST} - (SELECT count(*) FROM first_pass)"""


def mention_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.mention_summary(mentions(spark, sf_dir))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spark, sf_dir).select("id", "military_hits", "category", "region", "severity", "score", "keep", "strategic",
        "relevant")


def map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(region_on_map(F.col("lat"), F.col("lon")).alias("map_region"),
        region_for_quota(*map(F.col, ("lat", "lon", "country")), F.lit("")).alias("quota_region"))
    return rows.groupBy("map_region", "quota_region").agg(F.count("*").alias("n"))


def calibration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.calibration(_bucketed(spark, sf_dir))


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    unknown = lambda c, n: F.when(k % n != 0, F.col(c)).alias(c)
    rows = scored_events(spark, sf_dir)
    return rows.select(unknown("region", 19), unknown("category", 17), unknown("country", 13), unknown("domain", 11),
        F.when(k % 7 != 0, F.when(k % 2 == 0, "cyber").otherwise("maritime")).alias("bucket"), "strategic")


def calibration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values of each facet in one line."""
    return rollups.calibration_text(rollups.calibration(_bucketed(spark, sf_dir)), 3)


def grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.grid_clusters(scored_events(spark, sf_dir), size=20)


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir)
    return rollups.cluster_members(rows, rollups.grid_clusters(rows, size=20), size=20).select("cell_lat", "cell_lon", "id", "score",
        "rank")


def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).withColumn("quota_region", region_for_quota(*map(F.col, ("lat", "lon", "country")), F.lit("")))
    return selection.quota_select(rows, "quota_region", selection.QUOTAS, MOST, *_order()).select("id", "quota_region", "score")


def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keep_one(scored_events(spark, sf_dir), ["title"], *_order()).select("id", "title", "score")


def greedy_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy removal by title, by domain with place cell, and by code with country."""
    from ..storage import Stage

    rows = scored_events(spark, sf_dir).withColumns({
        "place_key": F.concat_ws("|", "domain", F.floor("lat").cast("string")),
        "code_key": F.when(F.col("strategic"), F.concat_ws("|", "code", "country", F.floor("lon").cast("string"))),
    })
    kept = selection.greedy_distinct(rows.select("id", "title", "place_key", "code_key", "score"), ["title", "place_key", "code_key"],
        [(-F.col("score")).alias("by_score"), F.col("id").alias("by_id")], Stage(spark, "greedy"))
    return kept.select("id", "score")


def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("words", word_set(F.col("title")))
    found = similarity.similar_pairs(rows, "words", 0.55)
    return found.select("a", "b", F.floor(F.col("similarity") * 10000 + 0.5).cast("long").alias("similarity"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spark, sf_dir).select("id", similarity.fingerprint(F.col("title"), F.col("country"),
            F.col("category")).alias("fingerprint"))


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).where(F.col("severity").isin("CRITICAL", "SEVERE")
        & F.col("region").isin("africa", "europe", "east_asia") & (F.col("category") != "discard"))
    return rows.select("id", "severity", "region", "category")


def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 800 first by score, strength of tone and id."""
    return scored_events(spark, sf_dir).orderBy(F.desc("score"), F.desc(F.abs("tone")), "id").limit(800).select("id", "score")


def unseen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose fingerprint isn't that of a labelled document."""
    rows = scored_events(spark, sf_dir).withColumn("fingerprint",
        similarity.fingerprint(F.col("title"), F.col("country"), F.col("category")))
    seen = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id")).join(rows,
        "id").select("fingerprint").distinct()
    return rows.join(seen, "fingerprint", "left_anti").select("id")


QUERIES = {f.__name__: f for f in (
    a_curated_events, mention_argmax, event_scores, map_regions, calibration_counts, calibration_text, grid_clusters, cluster_members,
        quota_selection,
    keep_best, greedy_multi_key, similar_titles, fingerprints, facet_filter, top_events, unseen_events,
)}

_FACETS_SQL = "facets AS (" + " UNION ALL ".join(f"SELECT '{n}' AS facet, v AS value, count(*) AS n, sum(strategic::INT)::BIGINT AS n_strategic FROM (SELECT {v} AS v, strategic FROM scored) WHERE v IS NOT NULL GROUP BY v"
    for n, v in (
    ("region", "CASE WHEN id % 19 <> 0 THEN region ELSE 'other' END"),
        ("category", "CASE WHEN id % 17 <> 0 THEN category ELSE 'incident' END"), ("country", "CASE WHEN id % 13 <> 0 THEN country END"),
    ("domain", "CASE WHEN id % 11 <> 0 THEN domain END"),
        ("bucket", "CASE WHEN id % 7 = 0 THEN 'general' WHEN id % 2 = 0 THEN 'cyber' ELSE 'maritime' END"),
)) + ")"
_FINGERPRINT_SQL = "sha1(title || '|' || country || '|' || category)"
_CELLS_SQL = "SELECT *, (floor(lat / 20 + 0.5) * 20)::INT AS cell_lat, (floor(lon / 20 + 0.5) * 20)::INT AS cell_lon FROM scored"
_CLUSTERS_SQL = "SELECT cell_lat, cell_lon, count(*) AS n, max(score) AS top_score FROM cells GROUP BY ALL HAVING count(*) >= 3 ORDER BY n DESC, cell_lat, cell_lon LIMIT 30"

SQL = {
    "a_curated_events": f"""WITH summary AS (SELECT event_id, count(*) AS mention_count FROM {MENTION_SQL} GROUP BY 1),
{SCORED_SQL.replace(f"FROM {EVENT_SQL}", f"FROM (SELECT e.* REPLACE (coalesce(mention_count, mentions) AS mentions) FROM {EVENT_SQL} e LEFT JOIN summary ON event_id = id)")},
good AS (SELECT *, {QUOTA_REGION_SQL} AS quota_region FROM scored WHERE relevant QUALIFY row_number() OVER (PARTITION BY title ORDER BY {_ORDER_SQL}) = 1),
{_quota_sql("good", "quota_region", "id, title, category, region, quota_region, severity, score, strategic, mentions")}""",
    "mention_argmax": f"""SELECT event_id, count(*) AS mention_count, arg_max(confidence, {{c: confidence, s: seq}}) FILTER (identifier <> '') AS best_confidence,
  arg_max(identifier, {{c: confidence, s: seq}}) FILTER (identifier <> '') AS best_identifier FROM {MENTION_SQL} GROUP BY event_id""",
    "event_scores": f"WITH {SCORED_SQL} SELECT id, military_hits, category, region, severity, score, keep, strategic, relevant FROM scored",
    "map_regions": f"SELECT {MAP_REGION_SQL} AS map_region, {QUOTA_REGION_SQL} AS quota_region, count(*) AS n FROM {EVENT_SQL} GROUP BY ALL",
    "calibration_counts": f"WITH {SCORED_SQL}, {_FACETS_SQL} SELECT * FROM facets",
    "calibration_text": f"""WITH {SCORED_SQL}, {_FACETS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM facets QUALIFY r <= 3)
SELECT facet, string_agg(value || '=' || n, ' ' ORDER BY r) AS text FROM r GROUP BY facet""",
    "grid_clusters": f"WITH {SCORED_SQL}, cells AS ({_CELLS_SQL}) {_CLUSTERS_SQL}",
    "cluster_members": f"""WITH {SCORED_SQL}, cells AS ({_CELLS_SQL}), best AS ({_CLUSTERS_SQL})
SELECT cell_lat, cell_lon, id, score, row_number() OVER (PARTITION BY cell_lat, cell_lon ORDER BY score DESC, id) AS rank FROM cells JOIN best USING (cell_lat, cell_lon) QUALIFY rank <= 10""",
    "quota_selection": f"WITH {SCORED_SQL}, good AS (SELECT *, {QUOTA_REGION_SQL} AS quota_region FROM scored), {_quota_sql('good', 'quota_region', 'id, quota_region, score')}",
    "keep_best": f"WITH {SCORED_SQL} SELECT id, title, score FROM scored QUALIFY row_number() OVER (PARTITION BY title ORDER BY {_ORDER_SQL}) = 1",
    "greedy_multi_key": f"""WITH RECURSIVE {SCORED_SQL},
line AS (SELECT id, score, list_filter(['1' || title, '2' || domain || '|' || floor(lat)::BIGINT, CASE WHEN strategic THEN '3' || code || '|' || country || '|' || floor(lon)::BIGINT END], lambda x: x IS NOT NULL) AS keys, row_number() OVER (ORDER BY score DESC, id) AS n FROM scored),
walk(n, id, ok, held) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] UNION ALL SELECT line.n, line.id, NOT list_has_any(held, keys), CASE WHEN list_has_any(held, keys) THEN held ELSE list_concat(held, keys) END FROM walk JOIN line ON line.n = walk.n + 1)
SELECT line.id, score FROM line JOIN walk ON walk.n = line.n AND ok""",
    "similar_titles": f"""WITH w AS (SELECT id, list_distinct(regexp_split_to_array(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+')) AS words FROM {EVENT_SQL})
SELECT x.id AS a, y.id AS b, floor(len(list_intersect(x.words, y.words))::DOUBLE / greatest(len(x.words), len(y.words)) * 10000 + 0.5)::BIGINT AS similarity
FROM w x JOIN w y ON x.id < y.id WHERE len(list_intersect(x.words, y.words))::DOUBLE / greatest(len(x.words), len(y.words)) > 0.55""",
    "fingerprints": f"WITH {SCORED_SQL} SELECT id, {_FINGERPRINT_SQL} AS fingerprint FROM scored",
    "facet_filter": f"WITH {SCORED_SQL} SELECT id, severity, region, category FROM scored WHERE severity IN ('CRITICAL', 'SEVERE') AND region IN ('africa', 'europe', 'east_asia') AND category <> 'discard'",
    "top_events": f"WITH {SCORED_SQL} SELECT id, score FROM scored ORDER BY score DESC, abs(tone) DESC, id LIMIT 800",
    "unseen_events": f"WITH {SCORED_SQL}, f AS (SELECT id, {_FINGERPRINT_SQL} AS fingerprint FROM scored) SELECT id FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f JOIN labels ON doc_id = id)",
}
