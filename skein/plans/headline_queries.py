"""Queries over the places, doubts and repeats of headlines, and answers that come as broken JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import places, providers
from ..storage import Stage
from .shims import table
from .signal_queries import _at, _pick, _q

STARTS = (
    "Pentagon confirms", "Russian forces strike", "China launches satellite", "Israel's navy", "Drone attack", "Breaking: missile hits",
        "Austin says ships",
    "Une frappe", "Troops mass", "Two killed", "Kremlin denies raid", "SpaceX launches rocket", "North Korea fires missile", "",
        "La Syrie condamne",
)
MIDDLES = (
    "in Kharkiv Amid Fierce Fighting", "near the occupied Sumy Region", "over the South China Sea Dispute", "at the Pentagon",
        "on Tuesday", "sur Damas", "dans le Donbass",
    "into Lebanon", "with software", "towards Springfield County", "captures Qom", "in Red Sea's North", "as Iranian ships wait",
        "near Zzyzx Base Camp", "en la Habana", "of in Ab",
)
ENDS = ("", "after talks", "off the Strait of Hormuz", "says Kremlin", "near Bab el-Mandeb", "amid Syrian crisis", "in Northrop Grumman",
    "as Taiwan holds drills")
GAZETTEER = (
    ("south china sea", 0, 0, 12.0, 114.0), ("red sea", 0, 1, 20.0, 38.5), ("strait of hormuz", 0, 2, 26.56, 56.25),
        ("hormuz", 0, 3, 26.56, 56.25), ("bab el-mandeb", 0, 4, 12.58, 43.33),
    ("pentagon", 0, 5, 38.87, -77.06), ("kremlin", 0, 6, 55.75, 37.62), ("donbass", 0, 7, 48.2, 38.0),
        ("north korea", 1, 0, 39.04, 125.76), ("taiwan", 1, 1, 23.7, 120.96),
    ("china", 1, 2, 39.9, 116.4), ("russia", 1, 3, 55.75, 37.62), ("iran", 1, 4, 35.69, 51.39), ("israel", 1, 5, 31.77, 35.22),
        ("syria", 1, 6, 33.51, 36.29), ("lebanon", 1, 7, 33.89, 35.5),
    ("syrie", 1, 8, 34.8, 38.9), ("lebanon", 2, 0, 40.3, -76.4), ("kharkiv", 2, 1, 50.0, 36.25), ("sumy", 2, 2, 50.9, 34.8),
        ("damas", 2, 3, 33.5, 36.3), ("qom", 2, 4, 34.6, 50.9),
    ("springfield", 2, 5, 39.8, -89.6), ("austin", 2, 6, 30.3, -97.7),
)
MENTIONS = (("north korea", "north korea", 0), ("korea", "north korea", 1), ("russian", "russia", 2), ("iranian", "iran", 3),
    ("syrian", "syria", 4), ("taiwan", "taiwan", 5), ("israel", "israel", 6), ("habana", "cuba", 7))
HINTS = ("France", "", "Iran", "")
GEO = (("place", "city", 0.25, "1.5"), ("military", "base", None, "2.5"), ("place", "hamlet", 0.34, "3.5"), ("shop", "mall", 0.9, "4.5"),
    ("boundary", "administrative", 0.24, "5.5"), ("water", "lake", 0.35, ""), ("natural", "sea", 0.3, "6.5"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.concat_ws(" ", _pick(STARTS, k), _pick(MIDDLES, k * 3 + 1), _pick(ENDS, k * 5 + 2))
    return table(spark, sf_dir, "documents").select(k.alias("key"), F.when(k % 31 != 30, title).alias("title"))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(GAZETTEER, "name string, kind int, ord int, lat double, lon double"), spark.createDataFrame(MENTIONS,
        "said string, canonical string, ord int")


def title_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that each headline tells of, and the stage that found it."""
    return places.places_of_titles(_titles(spark, sf_dir), *_tables(spark))


def _doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titles(spark, sf_dir)
    found = places.places_of_titles(rows, *_tables(spark)).select("key", "place")
    k = F.col("key")
    items = rows.join(found, "key", "left").select(k.alias("id"), "place", F.nullif(_pick(HINTS, k), F.lit("")).alias("hint"),
        F.when(k % 9 != 0, k % 90 + 5).alias("confidence"))
    return places.doubtful(items)


def title_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with their place or their feed's, and whether that is doubtful."""
    return _doubts(spark, sf_dir).select("id", "where", "hint_only", "doubt")


def doubt_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines after answers to all their doubts, whatever their number."""
    k = F.col("doc_id")
    answers = table(spark, sf_dir, "documents").where(k % 3 != 0).select(k.alias("id"),
        F.when(k % 4 != 0, F.concat(F.lit("town "), (k % 7).cast("string"))).alias("location"),
        F.when(k % 5 != 0, k % 100).alias("confidence"))
    out = places.answered(_doubts(spark, sf_dir), answers, most=2**62)
    return out.select("id", "where", "hint_only", "confidence")


def geocoder_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first trusted of the answers to each question."""
    k = F.col("o_orderkey")
    at = k * 3 % len(GEO)
    pick = lambda i: F.get(F.array(*(F.lit(g[i]) for g in GEO)), at.cast("int"))
    answers = table(spark, sf_dir, "orders").select((k % 997).alias("asked"), k.alias("ord"), pick(0).alias("class"),
        pick(1).alias("type"), pick(2).alias("importance"), pick(3).alias("lat"), F.lit("7.5").alias("lon"))
    return places.first_trusted(answers)


URLS = (
    "https://news.example/world/europe/2024/01/troops-move-to-the-border-{k}.html", "https://news.example/articles/{k}",
        "https://news.example/view?title=%D0%B2%D0%BE%D0%B9%D0%BD%D0%B0+{k}&id=1",
    "https://news.example/politics/world-news/", "https://news.example/0123456789abcdef0123/naval-drills.php",
        "https://news.example/956431-fleet-leaves-harbour", "https://news.example/en/short",
    "https://news.example/story/abcdefghijkl", "not a url",
        "https://news.example/caf%C3%A9-owners_protest+again/%E5%8C%97%E4%BA%AC-naval-base", "https://news.example/",
        "https://news.example/Fish%26amp%3BChips-war/ab-cd",
    "https://news.example/world-politics-opinion/defense-analysis", "https://news.example/one-two/two-one",
        "https://news.example/q?x=1&y=%EC%84%9C%EC%9A%B8_%EB%89%B4%EC%8A%A4/a-b",
)
# what each of them spells; {k} stands for a number that may be part of it
SPELT = (
    "troops move to the border", None, "война {k}", None, "naval drills", "fleet leaves harbour", None, None, None, "北京 naval base", None,
        "Fish&Chips war", None, "one two", "서울 뉴스/a-b",
)
CODES = ("1831", "195", "190", "0231", "145", "", "19", "2042", "18311")
NAMES = ("Carry out suicide bombing", "Employ aerial weapons", "Fight", "Unknown", "Protest violently, riot", "Unknown", "Unknown",
    "Use weapons of mass destruction", "Conduct bombing")
OBJECTS = (
    '{"location_name": " Odesa ", "summary": "Ships {moored} \\"here\\"", "key_points": [{"point": "a } b", "category": "Military"}, {"point": " ", "category": "x"}, {"point": "c"}]}',
    '{"summary": "x", "key_points": "none"}', "{}", '{"a": {"b": "\\\\"}, "summary": "deep"}', '{bad json}',
        '{"key_points": [{"point": "1"}, {"point": "2"}, {"point": "3"}, {"point": "4"}, {"point": "5"}, {"point": "6"}]}',
)
WRAPS = (("", "", 0), ("```json\n", "\n```", 0), ("Here you are: ", " Hope } that { helps", 0), ("```\n", "```", 0), ("", "", 1),
    ("no object", "", 99))


def url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title that each address spells, and the name of its code."""
    k = F.col("o_orderkey")
    url = F.replace(_pick(URLS, k), F.lit("{k}"), (k % 50).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.scored_title(url).alias("title"),
        text.sub_type(_pick(CODES, k * 4 + 1)).alias("kind"))


def broken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries out of answers with fences, words around them, or an end that is missing."""
    k = F.col("o_orderkey")
    at = (k * 5 % len(WRAPS)).cast("int")
    wrap = lambda i: F.get(F.array(*(F.lit(w[i]) for w in WRAPS)), at)
    body = _pick(OBJECTS, k)
    said = F.concat(wrap(0), F.substr(body, F.lit(1), F.greatest(F.length(body) - wrap(2), F.lit(0))), wrap(1))
    # each found and read once, whatever is taken from it: a generated one-row relation is not copied into its users
    once = lambda c: F.inline(F.array(F.struct(c)))
    found = table(spark, sf_dir, "orders").select(k.alias("id"), once(text.balanced_object(said).alias("object")))
    rows, a = found.select("*", once(text.answer_of(F.col("object")).alias("answer"))), F.col("answer")
    points = F.array_join(F.transform(a["key_points"], lambda p: F.concat(p["point"], F.lit("/"), p["category"])), ";")
    return rows.select("id", "object", a["location_name"].alias("place"), a["summary"].alias("summary"), points.alias("points"))


def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of at most 30 full cells: the title that has the most in common with the others, and the best titles."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat_ws(" ", _pick(STARTS, k * 7), _pick(MIDDLES, k * 3 + 1), _pick(ENDS, k * 5)).alias("title"),
            F.when(k % 4 != 0, _pick(("Military", "conflict"), k)).alias("category"),
        F.when(k % 3 != 0, "FR").alias("country"), (k * 37 % 101).alias("score"), ((k % 9) * 4 + k % 2 / F.lit(2.0)).alias("lat"),
            ((k % 5) * 6.0).alias("lon"),
    )
    out = providers.summaries(rows)
    return out.select("id", "country", "event_count", "location_name", "summary",
        F.array_join(F.transform("key_points", lambda p: F.concat(p["category"], F.lit(":"), p["point"])), "|").alias("points"))


def _provider(rows: list[dict]) -> str:
    """Answers to most rows, in words around the array."""
    said = [{"id": str(r["id"]), "keep": r["id"] % 6 != 0, "category": ("cyber", "no such")[r["id"] % 2],
            "country": ("ua", "FRA", 7)[r["id"] % 3], "fr": f"titre {r['id']}" if r["id"] % 4 else ""} for r in rows if r["id"] % 7]
    return f"Sure: {json.dumps(said)} - done"


def provider_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a provider was asked for them in batches."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("title "), k.cast("string")).alias("title"),
        _pick(("military", "discard", "conflict"), k).alias("category"), F.lit("US").alias("country"), (k % 97).alias("score"))
    out, _ = providers.filtered_by(rows, _provider, ("military", "conflict", "cyber"), Stage(spark, "provider"), limit=2**31 - 1)
    return out.select("id", "category", "country", "title_shown", "headline")


QUERIES = {f.__name__: f for f in (title_places, title_doubts, doubt_answers, geocoder_trust, url_titles, broken_answers,
        cluster_summaries, provider_batches)}

_TITLES = f"""t AS (SELECT doc_id AS key, CASE WHEN doc_id % 31 <> 30 THEN concat_ws(' ', {_at(STARTS, "doc_id")}, {_at(MIDDLES, "doc_id * 3 + 1")}, {_at(ENDS, "doc_id * 5 + 2")}) END AS title FROM documents),
g(name, kind, ord, lat, lon) AS (VALUES {', '.join(f"({_q(n)}, {k}, {o}, {a}::DOUBLE, {b}::DOUBLE)" for n, k, o, a, b in GAZETTEER)}),
m(said, canonical, ord) AS (VALUES {', '.join(f"({_q(s)}, {_q(c)}, {o})" for s, c, o in MENTIONS)})"""
_STOP = "[" + ", ".join(map(_q, places.STOPWORDS)) + "]"


def _named(patterns: tuple[str, ...]) -> str:
    found = " || ".join(f"regexp_extract_all(coalesce(title, ''), {_q(p)}, 1)" for p in patterns)
    cut = r"trim(regexp_replace(x, '(?i)[''\x{2019}]s$', ''))"
    return f"list_filter(list_transform({found}, lambda x: {cut}), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, lower(x)))"


def _known_sql(name: str, source: str, most: int, cities: bool) -> str:
    """Every known prefix of every candidate, with its place in the order of trying."""
    whole = f"SELECT key, pos, n, name, lower(name) AS e, 0 AS s FROM {name}_p"
    cut = f"regexp_replace(lower(name), {_q(places.SUFFIXES)}, '')"
    return f"""{name}_c AS (SELECT key, unnest({source}) AS c, generate_subscripts({source}, 1) AS pos FROM t),
{name}_w AS (SELECT key, pos, regexp_split_to_array(c, '\\s+') AS w FROM {name}_c),
{name}_p AS (SELECT key, pos, n, array_to_string(w[1:n], ' ') AS name FROM {name}_w, unnest(range(1, {most + 1})) AS r(n) WHERE n <= len(w) AND NOT list_contains({_STOP}, lower(array_to_string(w[1:n], ' ')))),
{name}_k AS (SELECT a.*, g.kind, g.ord, g.lat, g.lon FROM ({whole}{f" UNION ALL SELECT key, pos, n, name, {cut}, 1 FROM {name}_p WHERE {cut} <> lower(name)" if cities else ""}) a JOIN g ON g.name = a.e{"" if cities else " WHERE g.kind < 2"})"""


_PLACES = f"""{_TITLES}, {_known_sql("loc", _named(places.LOCATIVE), 4, True)}, {_known_sql("sub", _named(places.SUBJECT), 3, False)},
zone AS (SELECT key, name, lat, lon, 1 AS stage, -length(name) AS a, ord AS b FROM t, g WHERE kind = 0 AND name NOT IN ('pentagon', 'white house', 'kremlin') AND regexp_matches(lower(title), '\\b' || name || '\\b')),
land AS (SELECT key, canonical, b.lat, b.lon, 4 AS stage, -length(said) AS a, m.ord AS b FROM t, m JOIN (SELECT name, arg_min(lat, kind * 1000 + ord) AS lat, arg_min(lon, kind * 1000 + ord) AS lon FROM g GROUP BY name) b ON b.name = canonical WHERE regexp_matches(lower(title), '\\b' || said || '\\b')),
safe AS (SELECT key, c, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, 5 AS stage, pos AS a, 0 AS b FROM loc_c WHERE length(c) >= 4 AND len(regexp_split_to_array(c, '\\s+')) <= 3
  AND len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: list_contains({_STOP}, regexp_replace(lower(w), '[^a-zA-Z0-9_\\x{{E0}}-\\x{{FF}}''-]', '', 'g')))) = 0),
found AS (SELECT *, 0 AS c, 0 AS d FROM zone UNION ALL SELECT key, name, lat, lon, 2, pos, -n, s, kind * 1000 + ord FROM loc_k UNION ALL SELECT key, lower(name), lat, lon, 3, pos, -n, s, kind * 1000 + ord FROM sub_k UNION ALL SELECT *, 0, 0 FROM land UNION ALL SELECT *, 0, 0 FROM safe),
place AS (SELECT key, name AS place, stage, lat, lon FROM found QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, a, b, c, d) = 1)"""
_DOUBTS = f"""{_PLACES}, i AS (SELECT t.key AS id, coalesce(place, '') AS own, coalesce({_at(HINTS, "t.key")}, '') AS hint, CASE WHEN t.key % 9 <> 0 THEN t.key % 90 + 5 END AS confidence FROM t LEFT JOIN place USING (key)),
d AS (SELECT id, CASE WHEN own <> '' THEN own ELSE hint END AS w, own = '' AND hint <> '' AS hint_only, confidence, own = '' OR coalesce(confidence, 0) < 40 AS doubt FROM i)"""

_TITLE_OF = f"concat_ws(' ', {_at(STARTS, 'doc_id * 7')}, {_at(MIDDLES, 'doc_id * 3 + 1')}, {_at(ENDS, 'doc_id * 5')})"


def _cases(values: tuple, k: str) -> str:
    return f"CASE ({k}) % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values) if v is not None) + " END"


# what is in each object, as a person reads it
_READ = (("Odesa", 'Ships {moored} "here"', "a } b/military;c/conflict"), ("", "x", ""), ("", "", ""), ("", "deep", ""),
    (None, None, None), ("", "", "1/conflict;2/conflict;3/conflict;4/conflict;5/conflict"))

SQL = {
    "url_titles": f"SELECT o_orderkey AS id, replace({_cases(SPELT, 'o_orderkey')}, '{{k}}', (o_orderkey % 50)::VARCHAR) AS title, {_cases(NAMES, 'o_orderkey * 4 + 1')} AS kind FROM orders",
    "broken_answers": f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey * 5 % {len(WRAPS)} < 4 AS whole, {_cases(OBJECTS, 'o_orderkey')} AS obj, {_cases(tuple(r[0] for r in _READ), 'o_orderkey')} AS place,
  {_cases(tuple(r[1] for r in _READ), 'o_orderkey')} AS summary, {_cases(tuple(r[2] for r in _READ), 'o_orderkey')} AS points FROM orders)
SELECT id, CASE WHEN whole THEN obj END AS object, CASE WHEN whole THEN place END AS place, CASE WHEN whole THEN summary END AS summary, CASE WHEN whole THEN points END AS points FROM o""",
    "cluster_summaries": f"""WITH e AS (SELECT doc_id AS id, {_TITLE_OF} AS title, CASE WHEN doc_id % 4 <> 0 THEN lower({_at(("Military", "conflict"), "doc_id")}) ELSE 'conflict' END AS category, CASE WHEN doc_id % 3 <> 0 THEN 'FR' ELSE '' END AS country, doc_id * 37 % 101 AS score,
  (floor(((doc_id % 9) * 4 + doc_id % 2 / 2.0::DOUBLE) / 2 + 0.5) * 2)::INT AS la, ((doc_id % 5) * 6)::INT AS lo FROM documents),
c AS (SELECT la, lo, count(*) AS n FROM e GROUP BY la, lo HAVING n >= 3 ORDER BY n DESC, la, lo LIMIT 30),
t AS (SELECT e.*, n, row_number() OVER (PARTITION BY la, lo ORDER BY score DESC, id) AS r, list_distinct(regexp_split_to_array(regexp_replace(lower(title), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+')) AS w FROM e JOIN c USING (la, lo) QUALIFY r <= 10),
s AS (SELECT x.la, x.lo, x.r, x.title, round(coalesce(sum(len(list_intersect(x.w, y.w))::DOUBLE / greatest(len(x.w), len(y.w))), 0), 9) AS s FROM t x LEFT JOIN t y ON x.la = y.la AND x.lo = y.lo AND x.r <> y.r GROUP BY ALL),
m AS (SELECT la, lo, title AS summary FROM s QUALIFY row_number() OVER (PARTITION BY la, lo ORDER BY s DESC, r) = 1)
SELECT 'sig_' || la || '_' || lo AS id, max(country) FILTER (r = 1) AS country, max(n) AS event_count, coalesce(nullif(max(country) FILTER (r = 1), ''), la || '°, ' || lo || '°') AS location_name, summary,
  string_agg(category || ':' || title, '|' ORDER BY r) FILTER (r <= 5 AND title <> '') AS points FROM t JOIN m USING (la, lo) GROUP BY la, lo, summary""",
    "provider_batches": f"""WITH e AS (SELECT o_orderkey AS id, {_at(("military", "discard", "conflict"), "o_orderkey")} AS category FROM orders)
SELECT id, CASE WHEN id % 7 <> 0 AND id % 2 = 0 THEN 'cyber' ELSE category END AS category, CASE WHEN id % 7 <> 0 AND id % 3 = 0 THEN 'UA' ELSE 'US' END AS country,
  CASE WHEN id % 7 <> 0 AND id % 4 <> 0 THEN 'titre ' || id ELSE 'title ' || id END AS title_shown, NULL::VARCHAR AS headline
FROM e WHERE (id % 7 = 0 OR id % 6 <> 0) AND (category <> 'discard' OR (id % 7 <> 0 AND id % 2 = 0))""",
    "title_places": f"WITH {_PLACES} SELECT * FROM place",
    "title_doubts": f'WITH {_DOUBTS} SELECT id, w AS "where", hint_only, doubt FROM d',
    "doubt_answers": f"""WITH {_DOUBTS}, a AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'town ' || doc_id % 7 END AS location, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 100 END AS sure FROM documents WHERE doc_id % 3 <> 0)
SELECT d.id, CASE WHEN doubt AND location IS NOT NULL AND (w = '' OR hint_only) THEN location ELSE w END AS "where", hint_only AND NOT (doubt AND location IS NOT NULL) AS hint_only,
  CASE WHEN doubt AND sure IS NOT NULL THEN floor((confidence + sure) / 2.0::DOUBLE + 0.5)::BIGINT ELSE confidence END AS confidence FROM d LEFT JOIN a USING (id)""",
    "geocoder_trust": f"""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 997 AS asked, [{', '.join(f"{{c: {_q(c)}, t: {_q(t)}, i: {i if i is not None else 'NULL'}::DOUBLE, lat: {_q(la)}}}" for c, t, i, la in GEO)}][1 + o_orderkey * 3 % {len(GEO)}] AS r FROM orders),
b AS (SELECT *, r.lat <> '' AND (r.c IN ('military', 'aeroway') OR (r.c IN ('place', 'boundary', 'natural', 'water') AND coalesce(r.i, 0) >= CASE WHEN r.t IN ('country', 'state', 'region', 'administrative', 'city', 'sea', 'ocean') THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END)) AS good FROM a)
SELECT asked, try_cast(arg_min(r.lat, k) FILTER (good) AS DOUBLE) AS lat, CASE WHEN bool_or(good) THEN 7.5::DOUBLE END AS lon FROM b GROUP BY asked""",
}
