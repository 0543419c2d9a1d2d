"""The flagship and its parts, over events whose addresses, titles and documents the test tables number."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as words
from ..functions import text
from ..functions.geo import cell_tenth, region_of_event
from ..functions.text import KEPT, keyword_patterns, plain_word
from ..operators import curation, rollups
from ..storage import Stage
from .event_queries import QUOTA_REGION_SQL, REGION_SQL
from .shims import LAT_SQL, LON_SQL, MENTION_SQL, lat_of, lon_of, mentions, table
from .signal_queries import _at, _pick, _q

SUBJECTS = ("Missile brigade", "Army general", "Taxi drivers", "Naval exercise of warships", "Rebels and militia", "Café owners",
    "Police station", "Hackers", "Diplomats", "Armed group", "Troop buildup", "Farmers", "Sheriff of the county")
VERBS = ("attack border base", "announce ceasefire", "held by gang in", "clashes leave many killed near", "sanctions imposed on",
    "demand talks with", "murder suspect found in", "open festival in", "take hostage at", "protest for wages in", "shelling hits")
PLACES = ("Ukraine", "the harbor", "São Paulo", "Israel", "the stock market", "Gaza city", "a hospital", "Donetsk front", "the capital",
    "Taiwan strait", "Kabul")
HOSTS = ("www.tass.com", "news.example", "espn.com", "patch.com", "zazoom.it", "local.us", "kcna.kp", "daily.example")
CODES = ("UP", "FR", "US", "RS", "CH", "IZ", "CA", "BR", "IS", "KN")
THEMES = ("MILITARY_OPS", "ECON", "TAX_FNCACT", "ARMEDCONFLICT", "WB_SPACE")


def _title(k):
    return F.concat_ws(" ", _pick(SUBJECTS, k), _pick(VERBS, k * 3 + 1), _pick(PLACES, k * 7),
        F.when(k % 4 != 0, F.concat(F.lit("day "), (k % 37).cast("string"))))


_TITLE = f"concat_ws(' ', {_at(SUBJECTS, '{k}')}, {_at(VERBS, '{k} * 3 + 1')}, {_at(PLACES, '{k} * 7')}, CASE WHEN {{k}} % 4 <> 0 THEN 'day ' || {{k}} % 37 END)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    slug = F.regexp_replace(F.lower(_title(k)), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat(F.lit("https://"), _pick(HOSTS, k), F.lit("/world/"), slug,
                F.when(k % 6 == 0, "?utm=1&id=7#x").otherwise("/")).alias("url"),
        F.when(k % 3 != 0, "GOV").alias("actor1"), F.when(k % 5 == 0, "Rébel").alias("actor2"),
            F.lpad((1 + k % 20).cast("string"), 2, "0").alias("root"),
        F.when(k % 20 == 17, F.lpad((180 + k % 4).cast("string"), 3, "0")).otherwise(
            F.concat(F.lpad((1 + k % 20).cast("string"), 2, "0"), (k % 10).cast("string"))).alias("code"),
        _pick(CODES, k).alias("raw_country"), lat_of(k % 300).alias("lat"), lon_of(k % 300).alias("lon"),
            ((k * 37 % 201) / F.lit(10.0) - F.lit(10.0)).alias("goldstein"),
        F.when(k % 43 != 42, k % 7).alias("sources"), F.when(k % 37 != 36, k % 11).alias("articles"),
            F.when(k % 29 != 28, k % 23).alias("mentions"), (1 + k % 4).alias("geo_type"),
            F.when(k % 41 != 40, (k % 30).cast("double")).alias("age_h"),
        F.concat(F.lit("202401"), F.lpad((1 + k % 3).cast("string"), 2, "0"), F.lpad((k % 24).cast("string"), 2, "0"),
            F.lit("0000")).alias("added"),
    )


def gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every third event's own address, some twice, with themes, organizations, persons and a page title."""
    rows = events(spark, sf_dir).where("id % 3 = 0")
    k = F.col("id")
    made = rows.select(
        F.col("url").alias("address"), k.alias("seq"), F.array(_pick(THEMES, k)).alias("themes"),
            F.when(k % 2 == 0, F.array(F.lit("Ministry of Defence"))).alias("organizations"),
            F.when(k % 4 == 0, F.array(F.lit("General X"))).alias("persons"),
        F.when(k % 9 != 0, F.concat(F.lit("<A/><PAGE_TITLE> "), _title(k), F.lit(" &amp; more</PAGE_TITLE>"))).alias("extras"),
    )
    return curation.last_of_each(made)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their documents; the best mention of one in five is the next event's address, of the others it has none."""
    summary = rollups.mention_summary(mentions(spark, sf_dir).withColumn("identifier", F.lit(None).cast("string"))).drop("best_identifier")
    rows = events(spark, sf_dir)
    heard = rows.select((F.col("id") - 1).alias("event_id"), F.col("url").alias("best_identifier")).where("event_id % 5 = 2")
    return curation.joined(rows, summary.join(heard, "event_id", "left"), gkg(spark, sf_dir)).repartition(spark.sparkContext.defaultParallelism)  # so few bytes that they would be one task's


def a_flagship_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole refresh: joins, noise filters, scores, relevance, merging by four keys, diverse selection, quotas."""
    stage = Stage(spark, "curation")
    good = stage.keep(curation.curated(_joined(spark, sf_dir)).where("relevant"), "curated")
    out = curation.final_events(curation.diverse(curation.merged(good, stage)))
    return out.select("id", "title", "category", "country", "region", "quota_region", "severity", "score", "strategic")


CENTROIDS = (("FR", 46.6, 2.4), ("ML", 17.0, -4.0), ("UA", 49.0, 31.4), ("IR", 32.6, 54.3))
NEW_CODES = ("ML", "UA", "ir", "", "XX", "FRA", "FR")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country by cell of a tenth of a degree, for every fourth place of events."""
    k = F.col("id") % 300
    places = events(spark, sf_dir).where(k % 4 == 0).select(cell_tenth(F.col("lat"), F.col("lon")).alias("cell_key"),
        F.when(k % 8 == 0, "ML").otherwise("FR").alias("cell_country"))
    return places.groupBy("cell_key").agg(F.min("cell_country").alias("cell_country"))


def country_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country by cell or code, then a provider's country; events of a changed country at its centre."""
    rows = curation.corrected_country(events(spark, sf_dir), _cells(spark, sf_dir))
    rows = rows.withColumn("region", region_of_event(F.col("lat"), F.col("lon"), F.col("country"))).withColumn("original_country",
        F.when(F.col("id") % 10 != 9, F.col("country")))
    said = F.when(F.col("id") % 3 == 0, _pick(NEW_CODES, F.col("id")))
    rows = rows.withColumn("country", F.coalesce(F.nullif(said, F.lit("")), "country"))
    out = curation.recentred(rows, spark.createDataFrame(CENTROIDS, "code string, mid_lat double, mid_lon double"))
    return out.select("id", "country", "geo_suspect", "region", "moved", F.floor(F.col("lat") * 100 + 0.5).cast("long").alias("lat"),
        F.floor(F.col("lon") * 100 + 0.5).cast("long").alias("lon"))


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(spark, sf_dir)
    return rows.select("id", "mention_count", F.array_join("themes", ";").alias("themes"), F.array_join("persons", ";").alias("persons"),
        F.col("extras").isNotNull().alias("titled"))


def curated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.curated(_joined(spark, sf_dir)).select("id", "title", "domain", "military_hits", "category", "country", "region",
        "score", "strategic", "relevant")


def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.merge_keys(curation.curated(_joined(spark, sf_dir))).select("id", *curation.KEYS)


def diverse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.diverse(curation.curated(_joined(spark, sf_dir)), 20, 60).select("id", "score", "strategic")


QUERIES = {f.__name__: f for f in (a_flagship_events, event_documents, curated_scores, merge_keys, diverse_events, country_corrections)}


def _normal(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({text}), 'àáâãäåçèéêëìíîïñòóôõöùúûüý', 'aaaaaaceeeeiiiinooooouuuuy'), '[^{KEPT}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _hit(text: str, terms) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {_q(p)})" for p in keyword_patterns([plain_word(t) for t in terms]) if p) + ")"


def _part(text: str, terms) -> str:
    return f"regexp_matches({text}, {_q('|'.join(re.escape(plain_word(t)).replace(chr(92) + ' ', ' ').replace(chr(92) + '-', '-') for t in terms))})"


_IN = lambda names: "(" + ", ".join(map(_q, names)) + ")"
_YES = lambda test, n: f"CASE WHEN {test} THEN {n} ELSE 0 END"
_SLUG = f"regexp_replace(lower({_TITLE.format(k='doc_id')}), '[^a-z0-9]+', '-', 'g')"
_EVENTS = f"""ev AS (SELECT doc_id AS id, {_at(HOSTS, "doc_id")} AS host0, {_SLUG} AS slug, 'https://' || {_at(HOSTS, "doc_id")} || '/world/' || {_SLUG} || CASE WHEN doc_id % 6 = 0 THEN '?utm=1&id=7#x' ELSE '/' END AS url,
  CASE WHEN doc_id % 3 <> 0 THEN 'GOV' END AS actor1, CASE WHEN doc_id % 5 = 0 THEN 'Rébel' END AS actor2, lpad((1 + doc_id % 20)::VARCHAR, 2, '0') AS root,
  CASE WHEN doc_id % 20 = 17 THEN lpad((180 + doc_id % 4)::VARCHAR, 3, '0') ELSE lpad((1 + doc_id % 20)::VARCHAR, 2, '0') || (doc_id % 10)::VARCHAR END AS code, {_at(CODES, "doc_id")} AS raw,
  {LAT_SQL.format(k="(doc_id % 300)")} AS lat, {LON_SQL.format(k="(doc_id % 300)")} AS lon, ((doc_id * 37) % 201) / 10.0::DOUBLE - 10.0 AS g, CASE WHEN doc_id % 43 <> 42 THEN doc_id % 7 ELSE 0 END AS sources, CASE WHEN doc_id % 37 <> 36 THEN doc_id % 11 ELSE 0 END AS articles,
  CASE WHEN doc_id % 29 <> 28 THEN doc_id % 23 ELSE 0 END AS mentions, 1 + doc_id % 4 AS geo_type, CASE WHEN doc_id % 41 <> 40 THEN (doc_id % 30)::DOUBLE END AS age_h, '202401' || lpad((1 + doc_id % 3)::VARCHAR, 2, '0') || lpad((doc_id % 24)::VARCHAR, 2, '0') AS hour FROM documents),
docs AS (SELECT url, max(id) AS k FROM ev WHERE id % 3 = 0 GROUP BY url), summary AS (SELECT event_id AS id, count(*) AS mention_count FROM {MENTION_SQL} GROUP BY 1),
heard AS (SELECT a.id, b.id AS aid, b.url, b.host0, b.slug FROM ev a JOIN summary USING (id) JOIN ev b ON b.id = a.id + 1 WHERE a.id % 5 = 2),
told AS (SELECT ev.* EXCLUDE (url, host0, slug), ev.url AS own_url, coalesce(heard.url, ev.url) AS url, coalesce(heard.host0, ev.host0) AS host0, coalesce(heard.slug, ev.slug) AS slug, coalesce(aid, ev.id) AS aid FROM ev LEFT JOIN heard USING (id)),
found AS (SELECT told.*, mention_count, coalesce(a.k, o.k) AS k FROM told LEFT JOIN summary USING (id) LEFT JOIN docs a ON a.url = told.url LEFT JOIN docs o ON o.url = own_url),
js AS (SELECT *, CASE WHEN k IS NOT NULL THEN {_at(THEMES, "k")} END AS themes, CASE WHEN k % 2 = 0 THEN 'Ministry of Defence' END AS orgs, CASE WHEN k % 4 = 0 THEN 'General X' END AS persons, coalesce(k % 9 <> 0, false) AS titled FROM found)"""
_CODES_SQL = "CASE raw " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.FEED_TO_ISO.items()) + " ELSE raw END"
_RULES = " ".join(f"WHEN {_part('whole', terms)} THEN '{n}'" for n, _,
    terms in words.CATEGORIES) + " " + " ".join("WHEN " + " OR ".join(f"code LIKE '{c}%'" for c in codes) + f" THEN '{n}'" for n, codes,
    _ in words.CATEGORIES if codes)
_HOST_POINTS = "CASE domain " + " ".join(f"WHEN '{h}' THEN {p}" for h, p in words.HOST_POINTS.items()) + " ELSE 0 END"
# of "/world/<slug>" only the slug can be a title; of a slug with a number at its end that number goes
_SPELT = "regexp_replace(trim(regexp_replace(slug, '-+', ' ', 'g')), '( \\d+)+$', '')"
_SUB = "CASE " + " ".join(f"WHEN code[1:{n}] IN ({', '.join(map(repr, names))}) THEN CASE code[1:{n}] " + " ".join(f"WHEN '{c}' THEN {_q(t)}" for c, t in text.SUB_TYPES.items() if c in names) + " END" for n, names in ((4, [c for c in text.SUB_TYPES if len(c) == 4]), (3, [c for c in text.SUB_TYPES if len(c) == 3]))) + " ELSE 'Unknown' END"  # noqa: E501
_SCORED = f"""{_EVENTS},
t AS (SELECT *, regexp_replace(host0, '^www\\.', '') AS domain, CASE WHEN titled THEN {_TITLE.format(k="k")} || ' & more' ELSE {_SPELT} END AS title FROM js),
n AS (SELECT *, {_normal("concat_ws(' ', title, actor1, actor2, themes, orgs, persons)")} AS s, {_normal("concat_ws(' ', title, url)")} AS shown, {_normal(f"concat_ws(' ', title, actor1, actor2, themes, orgs, persons, {_SUB}, url)")} AS whole FROM t WHERE title <> ''),
f AS (SELECT *, {" + ".join(_hit("s", [w]) + "::INT" for w in dict.fromkeys(words.MILITARY))} AS military_hits, {_hit("s", words.GLOBAL_OVERRIDE)} AS outweighed, {_hit("s", words.CALMING)} AS calming
  FROM n WHERE domain NOT IN {_IN(words.NOISE_DOMAINS)} AND NOT {_hit("shown", words.NOISE)}),
fl AS (SELECT *, military_hits >= 1 AS military, military_hits >= 2 AS strong, {_hit("s", words.CIVILIAN_OVERRIDE + words.CIVILIAN_NOISE)} AND NOT {_hit("s", words.SECURITY_OVERRIDE)} AND military_hits < 1 AS civilian FROM f),
kept AS (SELECT * FROM fl WHERE CASE WHEN code IN ('155','181','1831','1832','1833') THEN true WHEN civilian AND NOT strong THEN false WHEN strong THEN true WHEN military AND (root IN ('13','14','15','16','17','18','19','20') OR sources >= 3) THEN true
    WHEN root NOT IN ('13','14','15','16','17','18','19','20') THEN false WHEN root IN ('18','19','20','14','15') THEN sources >= 2 ELSE sources >= 3 END
  AND NOT (domain IN {_IN(words.REJECTED_DOMAINS)} OR (domain IN {_IN(words.LOW_QUALITY_DOMAINS)} AND code NOT IN ('155','181','1831','1832','1833') AND NOT (root IN ('18','19','20') AND g <= -5)))
  AND NOT ((raw IN ('US','CA') OR domain LIKE '%.us') AND {_hit("s", words.DOMESTIC)} AND NOT outweighed) AND NOT (NOT outweighed AND NOT military AND ({_hit("s", words.LOCAL_ADMINISTRATION)} OR {_hit("s", words.CIVIL_CRIME)}))),
cat AS (SELECT *, CASE WHEN civilian AND NOT military THEN 'discard' WHEN code LIKE '155%' THEN 'cyber' WHEN code LIKE '1831%' OR code LIKE '1832%' OR code LIKE '1833%' THEN 'terrorism'
  WHEN code LIKE '181%' THEN CASE WHEN military OR regexp_matches(whole, '{curation.STRONG_TERROR}') OR (regexp_matches(whole, '{curation.WEAK_TERROR}') AND regexp_matches(whole, '{curation.ARMED}')) THEN 'terrorism' ELSE 'discard' END
  WHEN root IN ('18','19','20') THEN CASE WHEN military OR regexp_matches(whole, '{curation.VIOLENCE}') THEN 'conflict' ELSE 'incident' END WHEN root = '15' THEN CASE WHEN military THEN 'military' ELSE 'incident' END WHEN root = '14' THEN 'protest' {_RULES}
  WHEN root IN ('13','16','17') THEN CASE WHEN military OR regexp_matches(whole, '{curation.GEOPOLITICAL}') THEN 'strategic' ELSE 'incident' END ELSE 'discard' END AS category, {_CODES_SQL} AS country FROM kept),
reg AS (SELECT *, {REGION_SQL} AS region, coalesce(mention_count, mentions) AS seen FROM cat WHERE category <> 'discard'),
sc AS (SELECT *, floor(CASE WHEN code IN ('155','181','1831','1832','1833') THEN 44 WHEN root IN ('18','19','20') THEN 38 WHEN root = '15' THEN 34 WHEN root = '14' THEN 20 WHEN root IN ('13','16','17') THEN 24 ELSE 10 END
  + least(24.0::DOUBLE, abs(g) * 4) + least(12.0::DOUBLE, ln(1 + coalesce(sources, 0)) * 4) + least(12.0::DOUBLE, ln(1 + coalesce(articles, 0)) * 4) + least(14.0::DOUBLE, ln(1 + coalesce(seen, 0)) * 5) + CASE WHEN age_h IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, 16 - least(16.0::DOUBLE, age_h)) END
  + CASE geo_type WHEN 4 THEN 12 WHEN 3 THEN 8 WHEN 2 THEN 4 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN strong THEN 12 WHEN military THEN 5 ELSE 0 END + least(20.0::DOUBLE, {_HOST_POINTS} / 3.0::DOUBLE)
  + {_YES("country IN ('RU','CN','KP','KR','TW','VN','IR','SY','UA','IQ','AF','PK','LY','YE','SD')", 18)} + {_YES("region IN ('russia_cis','east_asia','middleeast','africa')", 8)} - {_YES('civilian', 45)} - {_YES('calming', 20)} - {_YES("NOT military AND root IN ('18','19','20')", 18)} + 0.5)::BIGINT
  + {_YES(f"regexp_matches(coalesce(themes, ''), '{curation.SCORED_THEMES}')", 12)} + {_YES(f"regexp_matches(coalesce(themes, ''), '{curation.CONTEXT_THEMES}')", 16)} + {_YES('orgs IS NOT NULL', 14)} + {_YES('persons IS NOT NULL', 6)} + {_YES(_hit('s', curation.CONTEXT_PHRASES), 8)} AS score FROM reg),
st AS (SELECT *, code IN ('155','181','1831','1832','1833') OR (root IN ('18','19','20') AND g <= -8) OR g <= -9.5 OR (score >= 130 AND country IN ('RU','CN','KP','KR','TW','VN','IR','SY','UA','IQ','AF','PK','LY','YE','SD')) OR score >= 150 AS strategic FROM sc),
cur AS (SELECT *, CASE WHEN sources < 2 AND NOT strategic AND score < 80 THEN false WHEN score >= 60 THEN true WHEN category = 'military' AND military AND sources >= 2 AND score >= 52 THEN true WHEN strategic AND score >= 52 THEN true ELSE category = 'conflict' AND sources >= 2 AND score >= 54 END AS relevant FROM st)"""
_TITLE_KEY = f"""trim(regexp_replace(regexp_replace(regexp_replace({_normal("title")}, '\\b\\d{{5,}}\\b', ' ', 'g'), '\\b[a-f0-9]{{8,}}\\b', ' ', 'g'), '\\s+', ' ', 'g'))[1:140]"""
_FAMILY = "list_filter(string_split(tk, ' '), lambda w: length(w) >= 4 AND w NOT IN ('after','before','first','images','historic','historical','mission','returns','return','earth','safely','crew','capsule','lunar','around','travel','journey','where','does','from','with'))[1:6]"
_KEYED = f"""tks AS (SELECT *, {_TITLE_KEY} AS tk FROM cur),
keyed AS (SELECT *, raw || '|' || root || '|' || hour || '|' || printf('%.2f', lat) || '|' || printf('%.2f', lon) || '|' || CASE WHEN actor1 IS NULL THEN '-' ELSE 'gov' END || '|' || CASE WHEN actor2 IS NULL THEN '-' ELSE 'rebel' END AS event_key,
  CASE WHEN aid % 6 = 0 THEN 'https://' || host0 || '/world/' || slug || '?id=7' ELSE 'https://' || host0 || '/world/' || slug END AS url_key, country || '|' || domain || '|' || hour || '|' || tk AS editorial_key,
  CASE WHEN len({_FAMILY}) > 0 THEN 'general|' || country || '|' || array_to_string({_FAMILY}, '|') END AS family_key FROM tks)"""
_QUOTAS = "('france', 40, 0), ('europe', 70, 1), ('russia_ukraine', 80, 2), ('east_asia', 75, 3), ('south_central_asia', 55, 4), ('middle_east', 90, 5), ('africa', 95, 6), ('south_america', 55, 7), ('north_america', 25, 8), ('oceania', 15, 9), ('other', 20, 10)"
_BUSY = _normal("concat_ws(' ', title, own_url, domain, actor1, actor2)")

_CELL = "floor(lat * 10 + 0.5)::BIGINT || ',' || floor(lon * 10 + 0.5)::BIGINT"
SQL = {
    "country_corrections": f"""WITH {_EVENTS}, p AS (SELECT *, {_CELL} AS cell, {_CODES_SQL} AS code_country FROM ev),
cells AS (SELECT cell, min(CASE WHEN id % 300 % 8 = 0 THEN 'ML' ELSE 'FR' END) AS cell_country FROM p WHERE id % 300 % 4 = 0 GROUP BY cell),
c AS (SELECT p.*, coalesce(cell_country, code_country) AS country, coalesce(cell_country <> code_country, false) AS geo_suspect FROM p LEFT JOIN cells USING (cell)),
r AS (SELECT *, {REGION_SQL} AS region FROM c), n AS (SELECT * EXCLUDE (country), CASE WHEN id % 10 <> 9 THEN country ELSE '' END AS was, coalesce(CASE WHEN id % 3 = 0 THEN nullif({_at(NEW_CODES, "id")}, '') END, country) AS country FROM r),
m(code, mid_lat, mid_lon) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in CENTROIDS)}),
j AS (SELECT n.* EXCLUDE (lat, lon, region, country), region AS old_region, country AS shown, upper(country) AS country, mid_lat IS NOT NULL AS moved, coalesce(mid_lat, lat) AS lat, coalesce(mid_lon, lon) AS lon FROM n LEFT JOIN m ON was <> '' AND m.code = upper(country) AND m.code <> was)
SELECT id, shown AS country, geo_suspect, CASE WHEN moved THEN {REGION_SQL} ELSE old_region END AS region, moved, floor(lat * 100 + 0.5)::BIGINT AS lat, floor(lon * 100 + 0.5)::BIGINT AS lon FROM j""",
    "event_documents": f"WITH {_EVENTS} SELECT id, mention_count, themes, persons, k IS NOT NULL AND k % 9 <> 0 AS titled FROM js",
    "curated_scores": f"WITH {_SCORED} SELECT id, title, domain, military_hits, category, country, region, score, strategic, relevant FROM cur",
    "merge_keys": f"WITH {_SCORED}, {_KEYED} SELECT id, event_key, url_key, editorial_key, family_key FROM keyed",
    "diverse_events": f"""WITH {_SCORED}, a AS (SELECT id, score, strategic, 0 AS p FROM cur WHERE strategic ORDER BY score DESC, id LIMIT 20), b AS (SELECT id, score, strategic, 1 AS p FROM cur WHERE id NOT IN (SELECT id FROM a))
SELECT id, score, strategic FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY p, score DESC, id LIMIT 60""",
    "a_flagship_events": f"""WITH RECURSIVE {_SCORED}, {_KEYED},
line AS (SELECT id, list_filter(['1' || event_key, '2' || url_key, '3' || editorial_key, '4' || family_key], lambda x: x IS NOT NULL) AS keys, row_number() OVER (ORDER BY score DESC, sources DESC, articles DESC, seen DESC, id) AS n FROM keyed WHERE relevant),
walk(n, id, ok, held) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] UNION ALL SELECT line.n, line.id, NOT list_has_any(held, keys), CASE WHEN list_has_any(held, keys) THEN held ELSE list_concat(held, keys) END FROM walk JOIN line ON line.n = walk.n + 1),
m AS (SELECT cur.* FROM cur JOIN walk ON walk.id = cur.id AND walk.ok),
d AS (SELECT * FROM (SELECT *, strategic AND row_number() OVER (PARTITION BY strategic ORDER BY score DESC, id) <= 200 AS lead FROM m) ORDER BY NOT lead, score DESC, id LIMIT 800),
q AS (SELECT *, {QUOTA_REGION_SQL} AS quota_region FROM d WHERE NOT ({_part(_BUSY, (*words.BUSINESS, *words.MEDICAL))} AND NOT {_part(_BUSY, words.SECURITY)})),
r AS (SELECT *, row_number() OVER (PARTITION BY quota_region ORDER BY score DESC, id) AS r FROM q), quotas(gr, qu, i) AS (VALUES {_QUOTAS}),
one AS (SELECT r.* FROM r JOIN quotas ON gr = quota_region WHERE r <= qu ORDER BY i, r LIMIT 600), two AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS z FROM r WHERE id NOT IN (SELECT id FROM one)),
fin AS (SELECT * FROM one UNION ALL SELECT * EXCLUDE (z) FROM two WHERE z <= 600 - (SELECT count(*) FROM one))
SELECT id, title, category, country, region, quota_region, CASE WHEN g <= -7 THEN 'CRITICAL' WHEN g <= -5 THEN 'SEVERE' WHEN g <= -2 THEN 'HIGH' WHEN g < 0 THEN 'MODERATE' ELSE 'LOW' END AS severity, score, strategic FROM fin""",
}
