"""Classification and scoring of events and tracks as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import region_of_event, severity, tone_color
from ..functions.numbers import clamp, half_up
from ..functions.text import keyword_hits

# Event codes, places and weights of the curated-event scale.
STRUCTURAL_ROOTS = ("13", "14", "15", "16", "17", "18", "19", "20")
STRUCTURAL_CODES = ("155", "181", "1831", "1832", "1833")
FORCE_ROOTS = ("18", "19", "20")
PRESSURE_ROOTS = ("13", "16", "17")
HOTSPOTS = ("RU", "CN", "KP", "KR", "TW", "VN", "IR", "SY", "UA", "IQ", "AF", "PK", "LY", "YE", "SD")
BOOSTED_REGIONS = ("russia_cis", "east_asia", "middleeast", "africa")
LEAST_SCORE = 60
#: Patterns of names and callsigns that the track rules count.
SHIP_NAME = r"(?i)^(USS|HMS|HMAS|HDMS|HNLMS|FS |FNS |RFS |INS |ROKS |JS |TCG|ITS |ESPS|NRP|HMCS|ADMIRAL |MARSHAL |VARYAG|SLAVA|MOSKVA|KUZNETSOV|UDALOY|SOVREMEN|STOIKY|NEUSTRASH|CNS |LIAONING|SHANDONG|FUJIAN|NANJING|GUANGZHOU|HARBIN|WUHAN|HAIKOU|LANZHOU|SHIJIAZHUANG)"
RULE_CALLSIGN = r"(?i)^(RCH|SAM|REACH|DUKE|MAGMA|COBRA|VIPER|HAWK|NATO|BAF|GAF|IAF|NAVY|USAF|CNV|TOPGUN|JOLLY|SPAR|EVAC|JAKE|SWIFT|KING|VALOR|BOXER|ATLAS|BLADE|BONE|GHOST|LANCER|FURY|RAVEN|IRON|STEEL|BRONZE|SILVER|GOLD|EAGLE|FALCON|THUNDER|STORM|WOLF|BEAR|TIGER|SHARK|LION)\d*"


@dataclass(frozen=True)
class Lexicons:
    """Word lists of one language setting; all matched on normalized text."""

    military: tuple[str, ...] = ("airstrike", "army", "artillery", "drone", "missile", "naval", "soldier", "tank", "troops", "war")
    civilian: tuple[str, ...] = ("celebrity", "festival", "football", "recipe", "weather")
    calming: tuple[str, ...] = ("ceasefire", "peace talks", "truce")


def flags(text: Column, words: Lexicons) -> dict[str, Column]:
    hits = keyword_hits(text, list(words.military))
    return {
        "military_hits": hits,
        "military": hits >= 1,
        "strong": hits >= 2,
        "civilian": keyword_hits(text, list(words.civilian)) > 0,
        "calming": keyword_hits(text, list(words.calming)) > 0,
    }


def category(root: Column, code: Column, military: Column, civilian: Column) -> Column:
    """The category by event code; text decides only where the code leaves it open."""
    return (
        F.when(civilian & ~military, "discard")
        .when(code.startswith("155"), "cyber")
        .when(code.startswith("1831") | code.startswith("1832") | code.startswith("1833"), "terrorism")
        .when(code.startswith("181"), F.when(military, "terrorism").otherwise("discard"))
        .when(root.isin(*FORCE_ROOTS), F.when(military, "conflict").otherwise("incident"))
        .when(root == "15", F.when(military, "military").otherwise("incident"))
        .when(root == "14", "protest")
        .when(root.isin(*PRESSURE_ROOTS), F.when(military, "strategic").otherwise("incident"))
        .otherwise("discard")
    )


def structural_points(root: Column, code: Column) -> Column:
    return (
        F.when(code.isin(*STRUCTURAL_CODES), 44).when(root.isin(*FORCE_ROOTS), 38).when(root == "15", 34)
        .when(root == "14", 20).when(root.isin(*PRESSURE_ROOTS), 24).otherwise(10)
    )


def visibility(sources: Column, articles: Column, mentions: Column) -> Column:
    """Points of coverage; what is unknown counts as none."""
    part = lambda x, k, most: F.least(F.lit(float(most)), F.log1p(F.coalesce(x.cast("double"), F.lit(0.0))) * float(k))
    return part(sources, 4, 12) + part(articles, 4, 12) + part(mentions, 5, 14)


def freshness(age_hours: Column) -> Column:
    """16 points less one an hour; none where the age is unknown."""
    return F.when(age_hours.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 16.0 - F.least(F.lit(16.0), F.greatest(F.lit(0.0), age_hours))))


def event_score(c: dict[str, Column]) -> Column:
    """Points of an event from its codes, tone, coverage, age, place and flags."""
    geo = F.when(c["geo_type"] == 4, 12).when(c["geo_type"] == 3, 8).when(c["geo_type"] == 2, 4).when(c["geo_type"] == 1, 1).otherwise(0)
    total = (
        structural_points(c["root"], c["code"])
        + F.least(F.lit(24.0), F.abs(F.coalesce(c["tone"], F.lit(0.0))) * 4)
        + visibility(c["sources"], c["articles"], c["mentions"])
        + freshness(c["age_h"])
        + geo
        + F.when(c["strong"], 12).when(c["military"], 5).otherwise(0)
        + F.when(c["country"].isin(*HOTSPOTS), 18).otherwise(0)
        + F.when(c["region"].isin(*BOOSTED_REGIONS), 8).otherwise(0)
        - F.when(c["civilian"], 45).otherwise(0)
        - F.when(c["calming"], 20).otherwise(0)
        - F.when(~c["military"] & c["root"].isin(*FORCE_ROOTS), 18).otherwise(0)
    )
    return half_up(total)


def keep_event(root: Column, code: Column, sources: Column, military: Column, strong: Column, civilian: Column) -> Column:
    structural, sources = root.isin(*STRUCTURAL_ROOTS), F.coalesce(sources, F.lit(0))
    return (
        F.when(code.isin(*STRUCTURAL_CODES), True)
        .when(civilian & ~strong, False)
        .when(strong, True)
        .when(military & (structural | (sources >= 3)), True)
        .when(~structural, False)
        .when(root.isin(*FORCE_ROOTS, "14", "15"), sources >= 2)
        .otherwise(sources >= 3)
    )


def is_strategic(root: Column, code: Column, goldstein: Column, score: Column, country: Column) -> Column:
    return code.isin(*STRUCTURAL_CODES) | (root.isin(*FORCE_ROOTS) & (goldstein <= -8)) | (goldstein <= -9.5) | ((score >= 130)
        & country.isin(*HOTSPOTS)) | (score >= 150)


def is_relevant(kind: Column, keep: Column, score: Column, sources: Column, strategic: Column, military: Column) -> Column:
    multi = F.coalesce(sources, F.lit(0)) >= 2
    return (
        F.when((kind == "discard") | ~keep, False)
        .when(~multi & ~strategic & (score < LEAST_SCORE + 20), False)
        .when(score >= LEAST_SCORE, True)
        .when((kind == "military") & military & multi & (score >= LEAST_SCORE - 8), True)
        .when(strategic & (score >= LEAST_SCORE - 8), True)
        .otherwise((kind == "conflict") & multi & (score >= LEAST_SCORE - 6))
    )


def _computed(df, columns: dict[str, Column]):
    """The rows with more columns, computed once however often later steps and filters use them.

    A generated one-row relation keeps the optimizer from copying the expressions into every user.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def scored(events, words: Lexicons = Lexicons()):
    """Events with flags, category, region, severity, colour, score, keep, strategic and relevant."""
    c = F.col
    out = _computed(events, flags(F.lower(c("title")), words) | {"region": region_of_event(c("lat"), c("lon"), c("country"))})
    names = ("geo_type", "root", "code", "tone", "sources", "articles", "mentions", "age_h", "strong", "military", "country", "region",
        "civilian", "calming")
    out = _computed(out, {
        "severity": severity(c("tone")), "color": tone_color(c("tone")),
        "category": category(*map(c, ("root", "code", "military", "civilian"))), "score": event_score({n: c(n) for n in names}),
        "keep": keep_event(*map(c, ("root", "code", "sources", "military", "strong", "civilian"))),
    })
    out = out.withColumn("strategic", is_strategic(*map(c, ("root", "code", "tone", "score", "country"))))
    return out.withColumn("relevant", is_relevant(*map(c, ("category", "keep", "score", "sources", "strategic", "military"))))


@dataclass(frozen=True)
class Rule:
    """Points and a reason for tracks of a domain that meet a condition."""

    name: str
    domain: str
    points: int
    when: Column
    reason: Column


def track_rules() -> list[Rule]:
    """The built-in rules; a user adds or replaces rules by passing another list. Points and bounds."""
    c = F.col
    return [
        Rule("ais-type", "sea", 70, c("ship_type") == 35, F.lit("military ship type")),
        Rule("warship-number", "sea", 60, c("warship_number"), F.lit("warship number")),
        Rule("name-prefix", "sea", 80, c("name").rlike(SHIP_NAME), F.lit("naval name prefix")),
        Rule("hex-range", "air", 85, c("military_hex"), F.lit("military address range")),
        Rule("callsign", "air", 50, F.trim("callsign").rlike(RULE_CALLSIGN), F.lit("military callsign")),
        Rule("type", "air", 60, c("military_type"), F.lit("military type")),
        Rule("airbase", "air", 30, c("base_km") < 250, F.lit("near an airbase")),
        Rule("altitude", "air", 15, c("alt_ft") > 35000, F.lit("high altitude")),
        Rule("speed", "air", 15, c("speed") > 450, F.lit("high speed")),
        Rule("no-callsign", "air", -20, F.coalesce(c("callsign"), F.lit("")) == "", F.lit("no callsign")),
        Rule("navy-country", "sea", 20, c("navy_country"), F.lit("known navy country")),
    ]


def rule_score(domain: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Clamped sum of the points of all rules that hold, and their reasons in rule order."""
    holds = [(r, (domain == r.domain) & F.coalesce(r.when, F.lit(False))) for r in rules]
    total = reduce(lambda a, b: a + b, (F.when(h, r.points).otherwise(0) for r, h in holds))
    return clamp(total, 0, 100), F.array_compact(F.array(*(F.when(h, r.reason) for r, h in holds)))


def tier(score: Column) -> Column:
    return F.when(score >= 75, "confirmed").when(score >= 50, "likely").when(score >= 25, "possible").otherwise("unknown")


def recency_penalty(age_hours: Column) -> Column:
    """0 up to six hours and for an unknown age, then more, 24 at most."""
    return F.when(age_hours.isNull() | (age_hours <= 6),
        F.lit(0)).otherwise(F.least(F.lit(24), half_up(10 * F.log2(1 + age_hours / 36)))).cast("long")


def fusion_points(km: Column, radius_km: float, confidence: Column, sensitive: Column) -> Column:
    sure = F.when(F.coalesce(confidence, F.lit(0)) == 0, 50).otherwise(confidence)
    return 18 * (1 - km / radius_km) * sure / 100 * F.when(sensitive, 1.15).otherwise(1.0)


def fusion_bonus(km: Column, radius_km: float, confidence: Column, sensitive: Column) -> Column:
    return half_up(fusion_points(km, radius_km, confidence, sensitive))
