"""The curated event set: joins of the feeds, noise filters, classes, scores, merging by four keys and diverse selection."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as words
from ..functions.geo import region_for_quota, region_of_event, severity
from ..functions.numbers import half_up
from ..functions.text import canonical_url, has_keyword, has_term, host, literal_array, literal_map, normalize, page_title, plain_word, scored_title, story_family, sub_type, title_key
from ..storage import Stage
from .scoring import BOOSTED_REGIONS, FORCE_ROOTS, HOTSPOTS, PRESSURE_ROOTS, STRUCTURAL_CODES, freshness, is_relevant, is_strategic, keep_event, structural_points, visibility
from .selection import QUOTAS, greedy_distinct, quota_select

# Patterns of texts, points and limits of the selection.
STRONG_TERROR = r"\b(suicide bomb|car bomb|ied|hostage|ransom|hijack|armed group|militant|terrorist|terror attack|captive)\b"
WEAK_TERROR, ARMED = r"\b(kidnap|abduct|seized by|detained by|held by)\b", r"\b(armed|militant|political|rebel|jihadist|cartel|gang|group|demand|claim)\b"
VIOLENCE = r"\b(killed|bombing|shelling|clashes|fighting|offensive|siege|rebel|militia|insurgent|guerrilla|ambush|attack(?:ed|s|ing)?)\b"
GEOPOLITICAL = r"\b(sanction|embargo|expel|diplomat|nuclear|weapon|ultimatum|blockade|annex)\b"
CONTEXT_THEMES = r"(?i)MILITARY|ARMED|MISSILE|NUCLEAR|TERROR|WAR|DEFENCE|DEFENSE|NAVAL|AVIATION|AIR_FORCE|AIRFORCE"
CONTEXT_ORGANIZATIONS = "ministry of defence|ministry of defense|defense ministry|defence ministry|armed forces|air force|navy|army|revolutionary guard|idf|pentagon|nato"
CONTEXT_PERSONS = "general|admiral|colonel|brigadier|commander"
CONTEXT_PHRASES = ("military exercise", "military drill", "field exercise", "munition", "ordnance", "airbase", "warship", "fighter jet",
    "fighter squadron")
SCORED_THEMES = r"(?i)MILITARY|ARMED|TERROR|CYBER|NUCLEAR|MISSILE|SPACE|AVIATION|MARITIME"
MOST_STRATEGIC, MOST_SELECTED, MOST_FINAL = 200, 800, 600
_EDGE = r"""[^\s\-_/.,;:!?"'()]"""


@dataclass(frozen=True)
class Lists:
    """The word lists of a setting; the built-in ones unless others are passed."""

    military: tuple[str, ...] = words.MILITARY
    noise: tuple[str, ...] = words.NOISE
    civilian: tuple[str, ...] = words.CIVILIAN_OVERRIDE + words.CIVILIAN_NOISE
    calming: tuple[str, ...] = words.CALMING


def _says(normalized: Column, terms: tuple[str, ...]) -> Column:
    return has_keyword(normalized, [plain_word(t) for t in terms])


def count_terms(normalized: Column, terms: tuple[str, ...]) -> Column:
    """How many different terms of a list a normalized text holds: single words in one pass, phrases as parts of the text."""
    plain = list(dict.fromkeys(plain_word(t) for t in terms))
    single, phrases = [t for t in plain if " " not in t and "-" not in t], [t for t in plain if " " in t or "-" in t]
    pattern = f"(?<!{_EDGE})(?:{'|'.join(map(re.escape, single))})(?!{_EDGE})"
    found = F.size(F.array_distinct(F.regexp_extract_all(normalized, F.lit(pattern), F.lit(0)))) if single else F.lit(0)
    return found + F.size(F.filter(literal_array(phrases), lambda t: normalized.contains(t))) if phrases else found


def joined(events: DataFrame, mentions: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Events with their mention summary and the document of the best mention's address, else of their own address.

    The feed of documents is optional: without it events have none.

    ``mentions``: event_id, mention_count, best_identifier; ``documents``: address, themes, organizations, persons, extras, one row an address.
    """
    rows = events.join(mentions.select(F.col("event_id").alias("id"), "mention_count", "best_identifier"), "id", "left")
    rows = rows.withColumn("address", F.coalesce(F.nullif("best_identifier", F.lit("")), "url"))
    fields = ["themes", "organizations", "persons", "extras"]
    if documents is None:
        lists = F.lit(None).cast("array<string>")
        return rows.withColumns({"themes": lists, "organizations": lists, "persons": lists, "extras": F.lit(None).cast("string")})
    side = lambda key, name: documents.select(F.col("address").alias(key), F.struct(*fields).alias(name))
    rows = rows.join(side("address", "own_"), "address", "left").join(side("url", "other_"), "url", "left")
    rows = rows.withColumn("document_", F.coalesce("own_", "other_"))
    return rows.select("*", *(F.col(f"document_.{f}").alias(f) for f in fields)).drop("own_", "other_", "document_")


def last_of_each(documents: DataFrame) -> DataFrame:
    """Of each address the last document."""
    fields = [c for c in documents.columns if c not in ("address", "seq")]
    last = documents.groupBy("address").agg(F.max_by(F.struct(*fields), "seq").alias("d"))
    return last.select("address", *(F.col(f"d.{c}").alias(c) for c in fields))


def two_letter(code: Column) -> Column:
    """The feed's country code as a two-letter code."""
    upper = F.upper(F.coalesce(code, F.lit("")))
    table = literal_map(words.FEED_TO_ISO)
    return F.coalesce(F.try_element_at(table, upper), upper)


def corrected_country(rows: DataFrame, cells: DataFrame | None) -> DataFrame:
    """``country`` from the cell of the place where that is known (cell_key, cell_country), else from the feed's code; ``geo_suspect`` where they differ."""
    rows = rows.withColumn("country", two_letter(F.col("raw_country")))
    if cells is None:
        return rows.withColumn("geo_suspect", F.lit(False))
    from ..functions.geo import cell_tenth

    rows = rows.withColumn("cell_key", cell_tenth(F.col("lat"), F.col("lon"))).join(cells, "cell_key", "left")
    differs = F.coalesce(F.col("cell_country") != F.col("country"), F.lit(False))
    return rows.withColumns({"geo_suspect": differs, "country": F.coalesce("cell_country", "country")}).drop("cell_key", "cell_country")


def recentred(rows: DataFrame, centroids: DataFrame, original: str = "original_country") -> DataFrame:
    """Events whose country was changed to another two-letter code move to that country's centre (code, mid_lat, mid_lon) and into its region.

    Without an original code, without a change, or where no centre is known, they stay where they are.
    """
    c = F.col
    was, now = F.upper(F.coalesce(original, F.lit(""))), F.upper(F.coalesce("country", F.lit("")))
    changed = (was != "") & (now != was) & (F.length(now) == 2)
    rows = rows.withColumn("to_", F.when(changed, now)).join(centroids.select(c("code").alias("to_"), "mid_lat", "mid_lon"), "to_", "left")
    moved = c("mid_lat").isNotNull() & c("mid_lon").isNotNull()
    rows = rows.withColumns({"lat": F.when(moved, c("mid_lat")).otherwise(c("lat")),
            "lon": F.when(moved, c("mid_lon")).otherwise(c("lon"))})
    region = F.when(moved, region_of_event(c("lat"), c("lon"), F.upper("country"))).otherwise(c("region"))
    return rows.withColumns({"region": region, "moved": moved}).drop("to_", "mid_lat", "mid_lon")


def _list(name: str) -> Column:
    return F.array_join(F.coalesce(name, F.array().cast("array<string>")), " ")


def text_of(*parts: Column) -> Column:
    """The parts that aren't empty, joined by blanks, in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " "))


def rejects_host(domain: Column, code: Column, root: Column, goldstein: Column) -> Column:
    weak = domain.isin(*words.LOW_QUALITY_DOMAINS) & ~code.isin(*STRUCTURAL_CODES) & ~(root.isin(*FORCE_ROOTS)
        & (F.coalesce(goldstein, F.lit(0.0)) <= -5))
    return domain.isin(*words.REJECTED_DOMAINS) | weak


def context_points(signal: Column) -> Column:
    """Points of themes, organizations, persons and phrases of military context."""
    yes = lambda x, n: F.when(x, n).otherwise(0)
    return (
        yes(_list("themes").rlike(CONTEXT_THEMES), 16) + yes(normalize(_list("organizations")).rlike(CONTEXT_ORGANIZATIONS), 14)
        + yes(normalize(_list("persons")).rlike(CONTEXT_PERSONS), 6) + yes(_says(signal, CONTEXT_PHRASES), 8)
    )


def category_of(text: Column, root: Column, code: Column, military: Column, civilian: Column) -> Column:
    """The category by code, then by words of the normalized text, then by the beginning of the code."""
    terror = text.rlike(STRONG_TERROR) | (text.rlike(WEAK_TERROR) & text.rlike(ARMED))
    out = F.when(root.isin(*PRESSURE_ROOTS), F.when(military | text.rlike(GEOPOLITICAL), "strategic").otherwise("incident")).otherwise(
        "discard")
    for name, codes, _ in reversed(words.CATEGORIES):
        if codes:
            out = F.when(reduce(lambda a, b: a | b, (code.startswith(c) for c in codes)), name).otherwise(out)
    for name, _, terms in reversed(words.CATEGORIES):
        out = F.when(has_term(text, [plain_word(t) for t in terms]), name).otherwise(out)
    return (
        F.when(civilian & ~military, "discard").when(code.startswith("155"), "cyber")
        .when(code.startswith("1831") | code.startswith("1832") | code.startswith("1833"), "terrorism")
        .when(code.startswith("181"), F.when(terror | military, "terrorism").otherwise("discard"))
        .when(root.isin(*FORCE_ROOTS), F.when(military | text.rlike(VIOLENCE), "conflict").otherwise("incident"))
        .when(root == "15", F.when(military, "military").otherwise("incident")).when(root == "14", "protest").otherwise(out)
    )


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with more columns, computed once however many later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def curated(rows: DataFrame, lists: Lists = Lists(), cells: DataFrame | None = None) -> DataFrame:
    """Joined events that are no noise, with title, category, country, region, tone, score and whether they are strategic.

    ``rows``: as ``joined`` gives them, of events with id, url, actor1, actor2, root, code, raw_country, lat, lon, goldstein, sources, articles,
    mentions, geo_type, age_h and added.
    """
    c = F.col
    counts = {n: F.coalesce(n, F.lit(0)) for n in ("sources", "articles", "mentions")}
    rows = _once(rows.withColumns(counts), {"domain": host(c("address")),
            "title": F.coalesce(page_title(c("extras")), scored_title(c("address")))}).where("title <> ''")
    signal = [c("title"), c("actor1"), c("actor2"), _list("themes"), _list("organizations"), _list("persons")]
    rows = _once(rows, {"signal": normalize(text_of(*signal)), "shown": normalize(text_of(c("title"), c("address")))})
    rows = rows.where(~c("domain").isin(*words.NOISE_DOMAINS) & ~_says(c("shown"), lists.noise))
    s = c("signal")
    rows = _once(rows, {"military_hits": count_terms(s, lists.military), "outweighed": _says(s, words.GLOBAL_OVERRIDE)})
    rows = _once(rows, {
        "military": c("military_hits") >= 1, "strong": c("military_hits") >= 2, "calming": _says(s, lists.calming),
        "civilian": _says(s, lists.civilian) & ~_says(s, words.SECURITY_OVERRIDE) & (c("military_hits") < 1),
    })
    domestic = (c("raw_country").isin("US", "CA") | c("domain").endswith(".us")) & _says(s, words.DOMESTIC) & ~c("outweighed")
    local = ~c("outweighed") & ~c("military") & (_says(s, words.LOCAL_ADMINISTRATION) | _says(s, words.CIVIL_CRIME))
    keep = keep_event(*map(c, ("root", "code", "sources", "military", "strong", "civilian")))
    rows = rows.where(keep & ~rejects_host(c("domain"), c("code"), c("root"), c("goldstein")) & ~F.coalesce(domestic, F.lit(False))
        & ~local)
    whole = normalize(text_of(*signal, sub_type(c("code")), c("address")))
    rows = _once(rows, {"category": category_of(whole, *map(c, ("root", "code", "military", "civilian")))}).where("category <> 'discard'")
    rows = corrected_country(rows, cells)
    rows = _once(rows, {"region": region_of_event(c("lat"), c("lon"), c("country")), "seen": F.coalesce("mention_count", "mentions")})
    points = literal_map(words.HOST_POINTS)
    geo = F.when(c("geo_type") == 4, 12).when(c("geo_type") == 3, 8).when(c("geo_type") == 2, 4).when(c("geo_type") == 1, 1).otherwise(0)
    yes = lambda x, n: F.when(x, n).otherwise(0)
    score = (
        structural_points(c("root"), c("code")) + F.least(F.lit(24.0), F.abs(F.coalesce("goldstein", F.lit(0.0))) * 4)
            + visibility(c("sources"), c("articles"), c("seen")) + freshness(c("age_h")) + geo
        + F.when(c("strong"), 12).when(c("military"), 5).otherwise(0)
            + F.least(F.lit(20.0), F.coalesce(F.try_element_at(points, c("domain")), F.lit(0)) / 3.0)
        + yes(c("country").isin(*HOTSPOTS), 18) + yes(c("region").isin(*BOOSTED_REGIONS), 8) - yes(c("civilian"), 45) - yes(c("calming"),
                20) - yes(~c("military") & c("root").isin(*FORCE_ROOTS), 18)
    )
    themed = F.exists(F.coalesce("themes", F.array().cast("array<string>")), lambda t: t.rlike(SCORED_THEMES))
    rows = _once(rows, {"score": half_up(score) + yes(themed, 12) + context_points(s), "severity": severity(c("goldstein"))})
    rows = rows.withColumn("strategic", is_strategic(*map(c, ("root", "code", "goldstein", "score", "country"))))
    relevant = is_relevant(c("category"), F.lit(True), c("score"), c("sources"), c("strategic"), c("military"))
    return rows.withColumn("relevant", relevant)


def merge_keys(rows: DataFrame) -> DataFrame:
    """The rows with four keys, of which two events of one story share at least one; null where a key says nothing."""
    c = F.col
    hour = F.substring(F.coalesce("added", F.lit("")), 1, 10)
    two = lambda x: F.when(x.isNotNull() & ~F.isnan(x), F.format_string("%.2f", x)).otherwise("na")
    actor = lambda x: F.coalesce(F.nullif(F.substring(normalize(x), 1, 80), F.lit("")), F.lit("-"))
    code = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("UNK"))
    return rows.withColumns({
        "event_key": F.concat_ws("|", code(c("raw_country")), F.coalesce(F.nullif("root", F.lit("")), F.lit("00")), hour, two(c("lat")),
            two(c("lon")), actor(c("actor1")), actor(c("actor2"))),
        "url_key": F.nullif(canonical_url(c("address")), F.lit("")),
        "editorial_key": F.concat_ws("|", code(c("country")), F.coalesce(F.nullif("domain", F.lit("")), F.lit("nodomain")), hour,
            title_key(c("title"))),
        "family_key": story_family(c("title"), F.lit("general"), c("country")),
    })


ORDER = ("score", "sources", "articles", "seen")
KEYS = ("event_key", "url_key", "editorial_key", "family_key")


def merged(rows: DataFrame, stage: Stage) -> DataFrame:
    """Best rows first, without any that shares a key with a kept one."""
    order = [(-F.coalesce(n, F.lit(0))).alias(f"by{i}") for i, n in enumerate(ORDER)] + [F.col("id").alias("by_id")]
    return greedy_distinct(merge_keys(rows), list(KEYS), order, stage)


def diverse(rows: DataFrame, most_strategic: int = MOST_STRATEGIC, most: int = MOST_SELECTED) -> DataFrame:
    """At most ``most`` rows: the best strategic ones first, then the best of the rest. Two ranked limits, whatever the input."""
    best = [F.desc("score"), F.col("id")]
    first = rows.where("strategic").orderBy(*best).limit(most_strategic).withColumn("first_", F.lit(0))
    rest = rows.orderBy(*best).limit(most + most_strategic).join(first.select("id"), "id", "left_anti").withColumn("first_", F.lit(1))
    return first.unionByName(rest).orderBy("first_", *best).limit(most).drop("first_")


def business_or_medical(rows: DataFrame) -> Column:
    """Business and medical words, as parts of words, without security words."""
    said = normalize(text_of(*map(F.col, ("title", "url", "domain", "actor1", "actor2"))))
    noise = [plain_word(t) for t in (*words.BUSINESS, *words.MEDICAL)]
    return has_term(said, noise) & ~has_term(said, list(words.SECURITY))


def final_events(rows: DataFrame, most: int = MOST_FINAL) -> DataFrame:
    """Without business and medical noise, regions filled up to their quotas, then with the best; at most ``most``, best first."""
    c = F.col
    kept = rows.where(~business_or_medical(rows)).withColumn("quota_region", region_for_quota(c("lat"), c("lon"), c("country"), F.lit("")))
    return quota_select(kept, "quota_region", QUOTAS, most, F.desc("score"), c("id")).orderBy(F.desc("score"), "id")
