"""Maritime, aviation and spatial signals: keyword and verb scores, event types, context, confidence and reality level."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from ..functions.numbers import clamp, half_up
from ..storage import Stage
from .scoring import fusion_bonus, fusion_points, recency_penalty
from .spatial import FIRST_LOOK, best_in_looks, near_pairs, top_within, within_km, zones_in_looks


@dataclass(frozen=True)
class Domain:
    """The tables of one kind of signal; a user passes another instance to change them."""

    name: str
    least: int
    weights: dict[str, int]
    types: tuple[tuple[str, int, tuple[str, ...]], ...]
    default: tuple[str, int]
    verbs: tuple[tuple[str, int], ...]
    penalties: tuple[tuple[str, int, str], ...]
    boosts: dict[str, int]
    other_boost: int
    recency: tuple[int, int] = (0, 0)


# Terms, weights, patterns and points of the three kinds of signals.
MARITIME = Domain(
    "maritime", 22,
    {
        "naval": 8, "warship": 12, "destroyer": 10, "frigate": 10, "corvette": 10, "submarine": 12, "carrier": 10, "fleet": 8,
            "task force": 10,
        "task group": 8, "amphibious": 8, "strait": 6, "eez": 6, "maritime": 5, "south china sea": 9, "taiwan strait": 10, "hormuz": 10,
        "gibraltar": 8, "suez": 8, "red sea": 8, "black sea": 8, "navy": 10, "coast guard": 7, "escort": 6, "blockade": 10,
            "transshipment": 8,
        "ship-to-ship": 10, "boarding": 8, "naval exercise": 12, "maritime patrol": 8, "merchant vessel": 8, "tanker": 8, "anti-ship": 10,
        "sea drone": 10, "vmf": 12, "russian navy": 12, "black sea fleet": 12, "pacific fleet": 10, "northern fleet": 10,
            "baltic fleet": 10,
        "houthis": 8, "houthi": 8,
    },
    (
        ("naval_exercise", 28, ("exercise", "drill", "maneuver", "war game", "task group")),
        ("fleet_deployment", 24, ("deployment", "deployed", "task force", "carrier strike group", "flotilla")),
        ("maritime_incident", 26, ("collision", "incident at sea", "intercepted", "harassed", "boarded", "seized")),
        ("port_call", 14, ("port visit", "arrived at port", "docked", "berthed")),
        ("chokepoint_tension", 30, ("strait", "hormuz", "gibraltar", "bab-el-mandeb", "suez", "taiwan strait")),
        ("logistics_operation", 20, ("replenishment", "resupply", "transfer at sea", "ship-to-ship", "loitering")),
    ),
    ("maritime_activity", 12),
    (
        (r"\bintercepted\b|\bblocked\b|\bboarded\b|\bseized\b", 16), (r"\bdeployed\b.{0,30}\b(fleet|task force|warship)\b", 12),
        (r"\bcollision\b|\bincident at sea\b|\bfired\b.{0,20}\bwarning\b", 14),
            (r"\bviolated\b.{0,20}\beez\b|\bentered\b.{0,20}\bterritorial waters\b", 14),
        (r"\bsank\b|\bdamaged\b.{0,20}\bship\b|\battacked\b.{0,20}\bvessel\b", 16),
            (r"\bblockade\b|\bescorted\b.{0,20}\bthrough\b|\bdenied passage\b", 12),
    ),
    (
        (r"\bopinion\b|\bop-ed\b|\bcommentary\b|\banalysis\b", 12, "opinion_content"),
            (r"\bforecast\b|\bprediction\b|\bscenario\b", 10, "speculative_content"),
        (r"\bhistorical\b|\bdecades ago\b|\byears ago\b", 14, "historical_content"),
            (r"\bshipbuilding contract\b|\bnaval contract\b|\bprocurement\b", 10, "procurement_content"),
        (r"\bthink tank\b|\bpolicy paper\b|\bwhite paper\b|\bstrategic review\b", 12, "doctrinal_content"),
            (r"\bwar game\b.{0,20}\bscenario\b|\btabletop\b", 8, "simulated_content"),
    ),
    {"military": 22, "strategic": 18, "conflict": 16, "crisis": 14, "incident": 10}, 6,
)
AVIATION = Domain(
    "aviation", 22,
    {
        "fighter": 10, "bomber": 12, "f-16": 11, "f-35": 11, "f-22": 11, "su-35": 11, "su-57": 12, "su-24": 10, "su-25": 10, "b-52": 12,
            "b-2": 12,
        "b-21": 13, "tu-160": 12, "tu-95": 12, "p-8": 10, "mq-9": 10, "rq-4": 10, "global hawk": 10, "predator drone": 9, "reaper": 9,
            "u-2": 10,
        "rc-135": 11, "awacs": 11, "rivet joint": 10, "typhoon": 8, "rafale": 8, "eurofighter": 8, "a-10": 9, "ac-130": 10, "ah-64": 9,
        "apache helicopter": 8, "scrambled": 12, "intercept": 11, "interception": 11, "airstrike": 14, "air strike": 14, "sortie": 10,
            "overfly": 9,
        "overflight": 10, "penetrat": 9, "shot down": 14, "downed": 12, "neutralized aircraft": 9, "air force": 9, "air base": 8,
            "airbase": 8,
        "air wing": 8, "squadron": 8, "drone": 9, "uav": 10, "shaheed": 11, "shahed": 11, "bayraktar": 10, "no-fly zone": 10, "notam": 8,
        "airspace": 7, "restricted airspace": 9, "air defense": 10, "s-400": 10, "patriot": 9, "iron dome": 10, "close air support": 10,
        "air superiority": 9, "air supremacy": 9,
    },
    (
        ("air_strike", 35, ("airstrike", "air strike", "bombing run", "targeted strike", "precision strike", "air attack", "bombed",
                "bomb drop")),
        ("air_interception", 32, ("intercept", "intercepted", "scrambled", "scramble", "shadowed", "buzzed", "close approach",
                "unsafe intercept", "dangerous intercept", "fighter jets scrambled")),
        ("air_patrol", 20, ("air patrol", "patrol aircraft", "surveillance flight", "reconnaissance flight", "isr", "awacs", "overwatch",
                "istar")),
        ("airspace_closure", 28, ("airspace closed", "notam", "no-fly zone", "flight restriction", "temporary flight restriction", "tfr",
                "closed airspace", "airspace violated")),
        ("air_exercise", 18, ("air exercise", "flying exercise", "combat training", "red flag", "pitch black", "tiger meet",
                "joint air exercise", "combined air exercise")),
        ("drone_operation", 26, ("drone", "uav", "unmanned aerial", "rpas", "shaheed", "shahed", "loitering munition", "kamikaze drone",
                "fpv drone", "bayraktar", "switchblade")),
        ("air_defense_engagement", 34, ("shot down", "downed aircraft", "air defense", "s-400", "s-300", "patriot system", "thaad",
                "surface-to-air", "anti-aircraft", "air defense activated", "iron dome activated")),
        ("air_deployment", 22, ("air deployment", "deployed aircraft", "forward deployed", "rotational deployment", "air reinforcements",
                "aircraft deployed")),
        ("air_incident", 24, ("aircraft crash", "near miss", "near-miss", "emergency landing", "mayday", "aviation incident",
                "aircraft incident", "midair")),
    ),
    ("aviation_activity", 10),
    (
        (r"\bstruck\b|\bbombed\b|\bhit\b.{0,40}\btarget\b|\battacked\b", 16),
            (r"\bscrambled\b|\bdispatched\b|\bdeployed\b.{0,30}\baircraf", 12),
        (r"\bintercepted\b|\bshadowed\b|\bescorted\b|\btracked\b", 12), (r"\bdowned\b|\bshot down\b|\bdestroyed\b.{0,30}\baircraf", 16),
        (r"\bcrossed into\b|\bentered\b.{0,30}\bairspace\b|\bviolated\b.{0,30}\bairspace\b", 14),
            (r"\bactivated\b.{0,30}\bair defense\b|\bfired\b.{0,20}\bmissile\b", 14),
        (r"\bcrashed\b|\bwent down\b|\bmayday\b", 10), (r"\boverflew\b|\bconducted\b.{0,30}\boverflight\b", 10),
    ),
    (
        (r"\bopinion\b|\bop-ed\b|\bcommentary\b|\banalysis\b", 12, "opinion_content"),
            (r"\bforecast\b|\bprediction\b|\bscenario\b", 10, "speculative_content"),
        (r"\bhistorical\b|\bdecades ago\b|\byears ago\b|\bduring world war\b", 14, "historical_content"),
        (r"\bcontract\b.*\baircraft\b|\bprocurement\b|\border\b.*\bjet\b|\bdelivery\b.*\bjet\b", 10, "procurement_content"),
        (r"\bthink tank\b|\bpolicy paper\b|\bwhite paper\b|\bstrategic review\b", 12, "doctrinal_content"),
            (r"\bsimulat|\bwargame\b|\btabletop\b|\bscenario planning\b", 8, "simulated_content"),
        (r"\bindus trial contract\b|\bdefense industry\b|\bmanufactur.*aircraft\b", 8, "industrial_content"),
    ),
    {"military": 22, "strategic": 18, "conflict": 16, "crisis": 14, "incident": 10}, 4, (8, 4),
)
SPATIAL = Domain(
    "spatial", 20,
    {
        "asat": 16, "anti-satellite": 16, "space weapon": 14, "counter-space": 12, "fractional orbital": 16, "fobs": 16,
            "orbital weapon": 16,
        "orbital bomb": 16, "co-orbital": 12, "kill vehicle": 14, "space force": 9, "space command": 9, "plassf": 14,
            "pla strategic support force": 14,
        "space domain": 8, "space domain awareness": 10, "space situational awareness": 10, "gps jamming": 14, "gps spoofing": 14,
            "gnss jamming": 12,
        "gnss spoofing": 12, "gps denied": 10, "navigation jamming": 10, "military satellite": 14, "spy satellite": 14,
            "reconnaissance satellite": 14,
        "classified payload": 14, "national security satellite": 12, "defense satellite": 10, "x-37": 12, "x-37b": 12, "spaceplane": 10,
            "norad": 8,
        "sda": 7, "ssa": 7, "satellite": 8, "orbital": 8, "orbit": 6, "launch vehicle": 10, "rocket launch": 10, "reentry": 8, "deorbit": 8,
        "debris field": 8, "maneuvering satellite": 12, "inspector satellite": 12, "rendezvous": 10, "proximity operation": 12,
            "hypersonic": 10,
        "ballistic missile": 10,
    },
    (
        ("military_launch", 35, ("military satellite", "reconnaissance satellite", "spy satellite", "military launch",
                "armed forces satellite", "defense satellite", "national security satellite", "classified payload", "classified satellite",
                "plassf", "pla strategic support force")),
        ("asat_indicator", 36, ("asat", "anti-satellite", "direct ascent", "co-orbital", "space weapon", "kill vehicle",
                "space-based weapon", "counter-space", "antisatellite")),
        ("orbital_weapon_signal", 36, ("fractional orbital", "fobs", "orbital bomb", "orbital weapon", "space-based weapon",
                "counter-space weapon")),
        ("gps_jamming", 30, ("gps jamming", "gps spoofing", "gnss jamming", "gnss spoofing", "navigation jamming", "signal jamming",
                "electronic warfare gps", "gps denied")),
        ("space_incident", 28, ("satellite collision", "space debris", "orbital debris", "fragmentation event", "satellite failure",
                "anomaly in orbit", "orbital anomaly")),
        ("reentry_risk", 26, ("reentry", "re-entry", "uncontrolled reentry", "space debris impact", "orbital decay", "deorbit",
                "decaying orbit")),
        ("space_surveillance", 24, ("space domain awareness", "space situational awareness", "ssa", "sda", "space object tracking",
                "orbital tracking", "space tracking")),
        ("space_exercise", 20, ("space exercise", "space war game", "orbital exercise", "space domain awareness exercise",
                "schriever wargame")),
        ("satellite_operation", 18, ("satellite", "orbital", "orbit", "geostationary", "maneuvering satellite", "inspector satellite",
                "rendezvous operation", "proximity operation")),
    ),
    ("space_activity", 8),
    (
        (r"\blaunched\b.{0,30}\b(satellite|rocket|missile|vehicle)\b", 16),
            (r"\bdetected\b.{0,30}\b(satellite|object|launch|debris)\b", 12),
        (r"\bjammed\b|\bspoofed\b|\binterfer.{0,15}\bsignal\b", 14), (r"\bdestroyed\b.{0,20}\bsatellite\b|\basat\b.{0,20}\btest\b", 18),
        (r"\breentered\b|\bdeorbited\b|\bfell.{0,20}\bearth\b|\bimpact\b.{0,20}\bdebris\b", 12),
            (r"\bmaneuver\b|\brendezvous\b|\bproximity operation\b", 14),
        (r"\bnew object\b|\bunknown object\b|\bunexplained\b.{0,20}\borbit\b", 12),
            (r"\bactivated\b|\bdeployed\b.{0,20}\b(satellite|system)\b", 10),
    ),
    (
        (r"\bopinion\b|\bop-ed\b|\bcommentary\b", 12, "opinion_content"),
            (r"\bforecast\b|\bprojection\b|\blong-term plan\b", 10, "speculative_content"),
        (r"\bhistorical\b|\bspace race\b.{0,20}\b196|\blegacy\b.{0,20}\bspace program\b", 12, "historical_content"),
        (r"\bcommercial satellite\b|\bbroadcast satellite\b|\bcommunications satellite\b(?!.*military)", 8, "commercial_content"),
        (r"\bscience\b.{0,20}\bmission\b|\bscientific\b.{0,20}\bsatellite\b|\btelescope\b", 10, "civilian_science"),
        (r"\bcontract\b|\bprocurement\b|\bindustrial\b|\bmanufactur", 8, "procurement_content"),
        (r"\bspace policy\b|\bspace law\b|\bouterspace treaty\b|\bspace governance\b", 10, "policy_content"),
    ),
    {"military": 20, "strategic": 16, "conflict": 12, "crisis": 10}, 4, (10, 5),
)
MOST_VERBS, MOST_PENALTY = 32, 40
#: Kinds of places of the maritime context with their radius in km and points.
RADII = {"base": (450.0, 18), "chokepoint": (300.0, 16), "port": (175.0, 8), "lane": (320.0, 6)}
ZONE_POINTS = 12


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def blob(*fields: Column) -> Column:
    """The fields that aren't empty, joined by blanks, in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*fields), lambda x: F.coalesce(x, F.lit("")) != ""), " "))


def keyword_score(text: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of all terms that the text holds."""
    return _sum(F.when(text.contains(t), w).otherwise(0) for t, w in weights.items())


def matched_terms(text: Column, weights: dict[str, int]) -> Column:
    """The terms that the text holds, heaviest first, in table order among equals."""
    terms = sorted(weights, key=lambda t: -weights[t])
    return F.array_compact(F.array(*(F.when(text.contains(t), F.lit(t)) for t in terms)))


def verb_score(text: Column, verbs: tuple[tuple[str, int], ...]) -> Column:
    return F.least(F.lit(MOST_VERBS), _sum(F.when(text.rlike(p), n).otherwise(0) for p, n in verbs))


def penalty(text: Column, penalties: tuple[tuple[str, int, str], ...]) -> Column:
    return F.least(F.lit(MOST_PENALTY), _sum(F.when(text.rlike(p), n).otherwise(0) for p, n, _ in penalties))


def penalty_labels(text: Column, penalties: tuple[tuple[str, int, str], ...]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for p, _, label in penalties)))


def event_type(text: Column, domain: Domain) -> tuple[Column, Column, Column]:
    """Type and weight of the heaviest rule that is over the default's weight, the first of equals, and the other types as tags."""
    hits = [(F.exists(F.array(*map(F.lit, terms)), lambda t: text.contains(t)), name, weight) for name, weight, terms in domain.types]
    best = F.struct(F.lit(domain.default[1]).alias("weight"), F.lit(1).alias("place"), F.lit(domain.default[0]).alias("name"))
    rules = [F.when(h, F.struct(F.lit(w).alias("weight"), F.lit(-i).alias("place"), F.lit(n).alias("name"))) for i,
        (h, n, w) in enumerate(hits)]
    best = F.array_max(F.array(best, *rules))
    tags = F.array_compact(F.array(*(F.when(h & (best["name"] != n), F.lit(n)) for h, n, _ in hits)))
    return best["name"], best["weight"], tags


def category_boost(category: Column, domain: Domain) -> Column:
    out = F.lit(domain.other_boost)
    for name, points in domain.boosts.items():
        out = F.when(category == name, points).otherwise(out)
    return out


def recency_score(age_h: Column, points: tuple[int, int]) -> Column:
    """Points for at most 6 and at most 24 hours; 0 for an unknown age."""
    return F.when(age_h <= 6, points[0]).when(age_h <= 24, points[1]).otherwise(0)


def reality_level(keywords: Column, verbs: Column, minus: Column, corroborated: Column) -> Column:
    operational = (verbs >= 10) | (keywords >= 22)
    return F.when((minus >= 20) & ~operational, "topic").when(corroborated, "corroborated_activity").when(operational,
        "operational_signal").otherwise("topic")


def activity_class(confidence: Column, kind: str, possible: int) -> Column:
    return F.when(confidence >= 75, f"probable_{kind}_activity").when(confidence >= possible, f"possible_{kind}_activity").otherwise(
        "weak_signal")


def description(kind: Column, *parts: Column) -> Column:
    """Type, dash, the parts that aren't empty; at most 280 characters."""
    told = F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    return F.substring(F.concat(F.translate(kind, "_", " "), F.lit(" — "), told), 1, 280)


def _scored(df: DataFrame, domain: Domain, text: Column) -> DataFrame:
    """The rows with their text and the scores that depend on nothing else, each computed once."""
    df = df.withColumn("blob", text)
    t = F.col("blob")
    name, weight, tags = event_type(t, domain)
    scores = {
        "keyword_score": keyword_score(t, domain.weights), "type": name, "type_weight": weight, "tags": tags,
            "verb_score": verb_score(t, domain.verbs),
        "penalty": penalty(t, domain.penalties), "category_boost": category_boost(F.col("category"), domain),
    }
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in scores.items())))))


def context(rows: DataFrame, places: DataFrame, key: str, widest_zone: float = 450.0) -> DataFrame:
    """The rows with nearest base, chokepoint, port and lane (each within its radius) and the first zone that holds them.

    ``places``: kind, site, site_lat, site_lon, radius_km (of zones, ``widest_zone`` at most), ord.
    """
    # each kind and the zones are joined apart, so that each looks no farther than it must
    spots = rows.select(key, "lat", "lon")
    kept = ("site", "km")
    found = [top_within(spots, places.where(F.col("kind") == k), key, "site", km, 1).select(key, F.lit(k).alias("kind_"), *kept)
        for k, (km, _) in RADII.items()]
    zones = zones_in_looks(spots, places.where(F.col("kind") == "zone"), key, "ord", widest_zone, *kept)
    every = reduce(lambda a, b: a.unionByName(b), [*found, zones.select(key, F.lit("zone").alias("kind_"), *kept)])
    kinds = [*RADII, "zone"]
    one = lambda k, x: F.max(F.when(F.col("kind_") == k, x))
    near = every.groupBy(key).agg(*(c for k in kinds for c in (one(k, F.col("site")).alias(k), one(k, half_up(F.col("km"))).alias(f"{k}_km"))))
    out = rows.join(near, key, "left")
    return out.withColumn("sensitive", F.col("base").isNotNull() | F.col("chokepoint").isNotNull() | F.col("zone").isNotNull())


def context_tags() -> Column:
    named = {"base": "near_naval_base", "chokepoint": "near_chokepoint", "port": "near_major_port", "zone": "inside_strategic_zone",
        "lane": "near_major_sea_lane"}
    return F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.lit(n)) for k, n in named.items())))


def maritime_signals(events: DataFrame, places: DataFrame, key: str = "id", widest_zone: float = 450.0) -> DataFrame:
    """Events of enough maritime relevance, with type, context, confidence and reality level.

    ``events``: key, title, actor1, actor2, sub_type, category, bucket, country, domain, url, lat, lon.
    """
    c = F.col
    rows = _scored(events.where("lat is not null and lon is not null"), MARITIME,
        blob(*map(c, ("title", "actor1", "actor2", "sub_type", "category", "bucket", "country", "domain", "url"))))
    actors, sub = F.concat_ws(" ", F.coalesce("actor1", F.lit("")), F.coalesce("actor2", F.lit(""))), F.coalesce("sub_type", F.lit(""))
    rows = rows.withColumns({
        "actor_boost": F.when(actors.rlike("(?i)navy|fleet|maritime|coast guard|destroyer|frigate|submarine"), 8).otherwise(0),
        "sub_boost": F.when(sub.rlike("(?i)naval|maritime|blockade|exercise|deployment|intercept"), 6).otherwise(0),
        "backend_boost": F.when(c("bucket") == "maritime", 16).otherwise(0),
        "zone_boost": F.when(c("blob").rlike("red sea|hormuz|bab el mandeb|suez|taiwan strait|south china sea|black sea|baltic sea"),
            8).otherwise(0),
    })
    rows = rows.withColumn("maritime_score", _sum(map(c,
                ("keyword_score", "category_boost", "actor_boost", "sub_boost", "backend_boost", "zone_boost"))))
    # no event below this can pass with any context
    rows = context(rows.where(c("maritime_score") >= MARITIME.least - 4), places, key, widest_zone)
    zoned = c("chokepoint").isNotNull() | c("zone").isNotNull() | c("lane").isNotNull()
    enough = (c("maritime_score") >= MARITIME.least) | ((c("backend_boost") > 0) & zoned)
    rows = rows.where(enough & ((c("keyword_score") > 0) | c("sensitive")))
    geo = _sum([*(F.when(c(k).isNotNull(), p).otherwise(0) for k, (_, p) in RADII.items()),
            F.when(c("zone").isNotNull(), ZONE_POINTS).otherwise(0)])
    raw = _sum(map(c, ("keyword_score", "type_weight", "verb_score", "category_boost", "actor_boost", "sub_boost"))) + geo
    rows = rows.withColumns({"geo_score": geo, "confidence": clamp(raw - c("penalty"), 0, 100)})
    return rows.withColumn("reality", reality_level(c("keyword_score"), c("verb_score"), c("penalty"), F.lit(False)))


def aviation_signals(events: DataFrame, bases: DataFrame, observed: DataFrame | None, key: str = "id") -> DataFrame:
    """Events of enough aviation relevance; nearest airbase within 400 km, aircraft observed within 250 km (null: no source loaded)."""
    c = F.col
    text = blob(*map(c, ("title", "actor1", "actor2", "sub_type", "category", "country", "domain", "url")))
    rows = _scored(events.where("lat is not null and lon is not null"), AVIATION, text).where(c("keyword_score") >= AVIATION.least)
    near = within_km(rows.select(key, "lat", "lon"), bases, 400.0).groupBy(key).agg(F.min(F.struct("km", "site")).alias("b"))
    rows = rows.join(near.select(key, c("b.site").alias("base"), half_up(c("b.km")).alias("base_km")), key, "left")
    if observed is None:
        rows = rows.withColumns({"n_observed": F.lit(0).cast("long"), "status": F.lit("not_observable")})
    else:
        seen = within_km(rows.select(key, "lat", "lon"), observed, 250.0).groupBy(key).agg(F.count("*").alias("n_observed"))
        rows = rows.join(seen, key, "left").withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))
        rows = rows.withColumn("status", F.when(c("n_observed") > 0, "matched").otherwise("not_found"))
    corroboration = F.when(c("status") == "matched", 8).otherwise(0)
    geo = F.when(c("base_km") < 100, 18).when(c("base_km") < 200, 12).when(c("base_km") < 400, 6).otherwise(0)
    rows = rows.withColumns({"geo_score": geo, "recency": recency_score(c("age_h"), AVIATION.recency), "corroboration": corroboration})
    raw = _sum(map(c, ("keyword_score", "type_weight", "verb_score", "category_boost", "geo_score", "recency", "corroboration")))
    rows = rows.withColumn("confidence", clamp(raw - c("penalty"), 0, 100))
    reality = reality_level(c("keyword_score"), c("verb_score"), c("penalty"), c("corroboration") > 0)
    return rows.withColumns({"reality": reality, "class": activity_class(c("confidence"), "air", 50)})


def named_in(rows: DataFrame, objects: DataFrame, key: str, text: str = "blob", letters: int = 6) -> DataFrame:
    """(key, n): how many objects have the first letters of their name in the row's text.

    Stretches of the text are joined to the names' beginnings by equality, so no pair is looked at that doesn't match.
    """
    begin = F.substring(F.lower("name"), 1, letters)
    known = objects.where(F.coalesce("name", F.lit("")) != "").groupBy(begin.alias("stretch")).agg(F.count("*").alias("n"))
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(letters)),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(F.col(text), i, n))))
    each = rows.where(F.length(text) > 0).select(key, F.explode(F.array_distinct(stretches)).alias("stretch"))
    return each.join(known, "stretch").groupBy(key).agg(F.sum("n").alias("n_named"))


def spatial_signals(events: DataFrame, objects: DataFrame, key: str = "id") -> DataFrame:
    """Events of enough spatial relevance; objects (name, high_interest) that the text names corroborate, else any of high interest."""
    c = F.col
    text = blob(*map(c, ("title", "actor1", "actor2", "sub_type", "category", "country", "domain")))
    rows = _scored(events.where("lat is not null and lon is not null"), SPATIAL, text).where(c("keyword_score") >= SPATIAL.least)
    high = objects.agg(F.count_if("high_interest").alias("n_high"))
    rows = rows.join(named_in(rows, objects, key), key, "left").join(F.broadcast(high))
    status = F.when(c("n_named") > 0, "matched").when(c("n_high") > 0, "high_interest_tip").otherwise("not_found")
    rows = rows.withColumns({"status": status, "recency": recency_score(c("age_h"), SPATIAL.recency)}).drop("n_high")
    rows = rows.withColumn("corroboration", F.when(c("status") == "matched", 14).when(c("status") == "high_interest_tip", 6).otherwise(0))
    raw = _sum(map(c, ("keyword_score", "type_weight", "verb_score", "category_boost", "recency", "corroboration")))
    rows = rows.withColumn("confidence", clamp(raw - c("penalty"), 0, 100))
    reality = reality_level(c("keyword_score"), c("verb_score"), c("penalty"), c("corroboration") > 0)
    return rows.withColumns({"reality": reality, "class": activity_class(c("confidence"), "space", 50)})


def naval_activity(signals: DataFrame, anomalies: DataFrame, key: str = "id", km: float = 220.0, most: int = 3) -> DataFrame:
    """Signals boosted by their best three anomalies nearby, less a penalty for age.

    ``anomalies``: anomaly, site_lat, site_lon, anomaly_confidence, anomaly_sensitive, source.
    """
    c = F.col
    told = F.struct((-c("bonus")).alias("minus"), half_up(c("km")).alias("km"), "anomaly", "source")
    # an anomaly gives this bonus only within so many km: first those that give a high one are looked for, then lower ones
    bonus = lambda far: fusion_bonus(far, km, c("anomaly_confidence"), c("anomaly_sensitive"))
    whole = fusion_bonus(F.lit(0.0), km, F.lit(100), F.lit(True))
    weight = fusion_points(F.lit(0.0), km, c("anomaly_confidence"), c("anomaly_sensitive"))
    reach = lambda least: F.when(weight > least - 0.5, km * (1 - (least - 0.5) / weight) + 1e-6)
    levels = range(signals.sparkSession.range(1).select(whole).first()[0], 0, -1)
    share = lambda least: F.sum(F.pow(F.sin(reach(least) / (2 * EARTH_KM)), 2)).alias(f"n{least}")
    expected = anomalies.where("site_lat is not null and site_lon is not null").agg(*map(share, levels)).first()
    steps, enough = [], float(FIRST_LOOK * most)
    for least in levels[:-1]:
        if (expected[f"n{least}"] or 0.0) >= enough:
            steps.append(least)
            enough *= 4

    def look(least: int):
        def pairs(rows: DataFrame) -> DataFrame:
            near = near_pairs(rows, anomalies, km, own=reach(least), step_km=km * max(0.05, 1 - (least - 0.5) / levels[0]))
            return near.withColumn("bonus", bonus(c("km"))).where(c("bonus") >= least).select(key, told.alias("told"))
        return pairs

    if steps:  # computed once
        signals = Stage(signals.sparkSession, "naval").keep(signals, "signals")
    best = best_in_looks(signals.select(key, "lat", "lon"), key, [look(n) for n in (*steps, 1)], most, "told")
    near = best.groupBy(key).agg(F.sort_array(F.collect_list("told")).alias("near"))
    near = near.select(key, "near", F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a - x["minus"]).alias("anomaly_bonus"),
        F.array_distinct(F.transform("near", lambda x: x["source"])).alias("sources"))
    rows = signals.join(near, key, "left").withColumn("anomaly_bonus", F.coalesce("anomaly_bonus", F.lit(0)))
    rows = rows.withColumn("recency_penalty", F.coalesce(recency_penalty(c("age_h")), F.lit(0)))
    boosted = clamp(c("confidence") + c("anomaly_bonus") - c("recency_penalty"), 0, 100)
    return rows.withColumn("boosted", boosted).withColumn("class", activity_class(c("boosted"), "naval", 55))
