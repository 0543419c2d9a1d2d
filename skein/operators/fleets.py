"""Aircraft and ships: wire formats, military tests, normal tracks and kinds of air activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, turn
from ..functions.numbers import half_up, hex_prefix
from .scoring import SHIP_NAME
from .tracks import last_points

# Address ranges (first match wins), number prefixes, patterns and type codes of military craft.
#: Ranges that a normal track is held against.
HEX_RANGES = (
    (0xADF7C8, 0xAFFFFF, "USA", "#4a9eff"), (0xA00000, 0xA0FFFF, "USA", "#4a9eff"), (0x43C000, 0x43FFFF, "GBR", "#60ddff"),
        (0x3B7000, 0x3B9FFF, "FRA", "#5588ff"),
    (0x3C4000, 0x3C5FFF, "DEU", "#aaddff"), (0xC03100, 0xC03FFF, "CAN", "#88ddff"), (0x7C4200, 0x7C42FF, "AUS", "#66ccff"),
        (0x3D0000, 0x3D1FFF, "ITA", "#99bbff"),
    (0x34B000, 0x34BFFF, "ESP", "#aabbff"), (0x480000, 0x480FFF, "NLD", "#88ccff"), (0x489000, 0x489FFF, "POL", "#8899ff"),
        (0x1A0000, 0x1AFFFF, "RUS", "#ff5555"),
    (0x100000, 0x1FFFFF, "RUS", "#ff5555"), (0x780000, 0x7BFFFF, "CHN", "#ff6644"), (0x738000, 0x738FFF, "ISR", "#ffcc55"),
        (0x4B8000, 0x4B8FFF, "TUR", "#ffaa44"),
    (0x840000, 0x85FFFF, "JPN", "#ff9966"), (0x71C000, 0x71CFFF, "KOR", "#ffbb55"), (0x456000, 0x456FFF, "NATO", "#00ffcc"),
)
#: Ranges that a report is taken by: with IRN and PRK, the second IRN range shadowing ISR.
INGEST_RANGES = (
    *HEX_RANGES[:11], (0x100000, 0x1FFFFF, "RUS", "#ff5555"), (0x1A0000, 0x1AFFFF, "RUS", "#ff5555"),
        (0x780000, 0x7BFFFF, "CHN", "#ff6644"),
    (0x730000, 0x737FFF, "IRN", "#ff9933"), (0x738000, 0x73FFFF, "IRN", "#ff9933"), (0x2A0000, 0x2A7FFF, "PRK", "#cc44ff"),
        (0x71C000, 0x71CFFF, "KOR", "#ffbb55"),
    (0x738000, 0x738FFF, "ISR", "#ffcc55"), (0x4B8000, 0x4B8FFF, "TUR", "#ffaa44"), (0x840000, 0x85FFFF, "JPN", "#ff9966"),
        (0x456000, 0x456FFF, "NATO", "#00ffcc"),
)
SHIP_PREFIXES = {
    "338": "USA", "366": "USA", "367": "USA", "368": "USA", "369": "USA", "232": "GBR", "233": "GBR", "234": "GBR", "235": "GBR",
        "226": "FRA", "227": "FRA",
    "228": "FRA", "211": "DEU", "212": "DEU", "316": "CAN", "503": "AUS", "247": "ITA", "248": "ITA", "224": "ESP", "225": "ESP",
        "244": "NLD", "245": "NLD",
    "261": "POL", "273": "RUS", "412": "CHN", "413": "CHN", "414": "CHN", "477": "CHN", "431": "JPN", "432": "JPN", "440": "KOR",
        "441": "KOR", "419": "IND",
    "422": "IRN", "378": "TUR", "271": "TUR", "276": "ISR", "563": "SGP", "525": "IDN", "636": "LBR",
}
CALLSIGN = r"(?i)^(RCH|SAM|REACH|DUKE|MAGMA|COBRA|VIPER|HAWK|NATO|BAF|GAF|IAF|NAVY|USAF|CNV|TOPGUN|JOLLY|SPAR|EVAC|JAKE|SWIFT|KING|VALOR|BOXER|ATLAS|BLADE|BONE|GHOST|LANCER|FURY|RAVEN|IRON|STEEL|BRONZE|SILVER|GOLD|EAGLE|FALCON|THUNDER|STORM|WOLF|BEAR|TIGER|SHARK|LION|BORT|CCCP|PLAAF|PLANAF|IRGC)\d*"
CIVIL_CALLSIGN = r"(?i)^(CCA|CES|CSN|CHH|CXA|CSZ|CSC|CDG|DKH|HXA|CQH|GCR|OKA|EPA|AXM|JAL|ANA|KAL|AAR|JJA|TWB|ABL|MAS|SIA|PAL|CPA|EVA|MXA|THA|GIA|GAR|AIC|EIN|BAW|AFR|DLH|KLM|IBE|AZA|TAP|SAS|UAL|AAL|DAL|SWA|FFT|SKW|ASA|JBU|HAL|AFL|SBI|UTN|SVR|TYA|VKO|IRM|IRC|IRA|JST|QFA|VOZ|TGW)\d+"
MILITARY_FAMILIES = ("MIG", "SU2", "SU3", "KA", "MI", "MQ", "RQ", "J1", "J2")
HELICOPTER_FAMILIES = ("MI", "KA", "KA5")
AWACS = ("E3", "E7", "A50", "KJ2000", "KJ500", "E737", "E767", "E2")
TANKER = ("KC135", "KC10", "KC46", "MRTT", "IL78", "Y20U", "A310")
ISR = ("RC135", "EP3", "P8", "P3", "P1", "U2", "TR1", "E8", "S3", "RQ4", "MQ9", "MQ1", "TU214R", "Y8G")
FEET, KNOTS = 3.281, 1.944


def _given(x: Column) -> Column:
    """The text trimmed, null where nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def hex_country(address: Column, ranges=HEX_RANGES) -> Column:
    """Country and colour of the first range that holds a hex address, null where none does."""
    value, out = hex_prefix(address), F.lit(None).cast("struct<country:string,color:string>")
    for low, high, country, color in reversed(ranges):
        out = F.when(value.between(low, high), F.struct(F.lit(country).alias("country"), F.lit(color).alias("color"))).otherwise(out)
    return out


def military_aircraft(address: Column, callsign: Column) -> Column:
    """Country and colour of a military aircraft: civil callsigns are none, then address ranges, then military callsigns."""
    named = F.trim(F.coalesce(callsign, F.lit("")))
    unknown = F.when(named.rlike(CALLSIGN), F.struct(F.lit("UNKNOWN").alias("country"), F.lit("#e8f4ff").alias("color")))
    return F.when(~named.rlike(CIVIL_CALLSIGN), F.coalesce(hex_country(address, INGEST_RANGES), unknown))


def ship_number(number: Column) -> Column:
    """(country, warship): from the three, else two first digits of a nine-digit number, after one leading zero, which marks a warship."""
    digits = F.lpad(number.cast("string"), 9, "0")
    warship = digits.startswith("0") & ~digits.startswith("00")
    cut = F.when(warship, F.substring(digits, 2, 8)).otherwise(digits)
    names = F.create_map(*(F.lit(x) for pair in SHIP_PREFIXES.items() for x in pair))
    country = F.coalesce(F.try_element_at(names, F.substring(cut, 1, 3)), F.try_element_at(names, F.substring(cut, 1, 2)))
    return F.struct(country.alias("country"), (warship & country.isNotNull()).alias("warship"))


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def military_type(code: Column, codes: tuple[str, ...]) -> Column:
    t = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return reduce(lambda a, b: a | b, (t.startswith(x) for x in MILITARY_FAMILIES), t.isin(*codes))


def helicopter_type(code: Column, codes: tuple[str, ...]) -> Column:
    t = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return reduce(lambda a, b: a | b, (t.startswith(x) for x in HELICOPTER_FAMILIES), t.isin(*codes))


AIRCRAFT = ("id", "callsign", "country", "color", "lon", "lat", "alt", "alt_ft", "speed", "track", "type")


def _taken(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """The rows with ``reject``: the first check that fails, null for accepted ones."""
    reject = F.lit(None).cast("string")
    for name, fails in reversed(checks):
        reject = F.when(fails, name).otherwise(reject)
    return rows.withColumn("reject", reject)


def from_states(states: DataFrame, column: str = "state") -> DataFrame:
    """Aircraft from positional arrays of text: 0 address, 1 callsign, 5 lon, 6 lat, 7 altitude m, 8 on ground, 9 speed m/s, 10 heading.

    Every row, with ``reject`` null for accepted ones.
    """
    at = lambda i: F.get(column, F.lit(i))
    number = lambda i: at(i).try_cast("double")
    address, callsign = F.lower(F.coalesce(at(0), F.lit(""))), _given(at(1))
    rows = states.withColumns({"id": address, "mil_": military_aircraft(address, callsign),
            "callsign": F.coalesce(callsign, F.upper(address)), "lon": number(5), "lat": number(6)})
    alt = half_up(number(7))
    rows = rows.withColumns({"alt": alt, "alt_ft": half_up(alt * FEET), "speed": half_up(number(9) * KNOTS),
            "track": F.coalesce(number(10), F.lit(0.0)), "type": F.lit(None).cast("string")})
    no_place = (F.coalesce("lon", F.lit(0.0)) == 0) | (F.coalesce("lat", F.lit(0.0)) == 0)
    rows = _taken(rows, [("no_position", no_place), ("on_ground", F.coalesce(at(8) == "true", F.lit(False))),
            ("not_military", F.col("mil_").isNull())])
    return rows.withColumns({"country": F.col("mil_.country"), "color": F.col("mil_.color")}).select(*AIRCRAFT, "reject")


def from_objects(objects: DataFrame) -> DataFrame:
    """Aircraft from objects (hex, flight, r, t, lat, lon, alt_baro as text, on_ground, gs, track); every row, with ``reject``."""
    c = F.col
    address = F.regexp_replace(F.lower(F.coalesce("hex", F.lit(""))), "^~", "")
    callsign = _given(F.coalesce(F.nullif("flight", F.lit("")), F.col("r")))
    grounded = F.coalesce(c("alt_baro") == "ground", F.lit(False)) | F.coalesce(c("on_ground"), F.lit(False))
    feet = half_up(c("alt_baro").try_cast("double"))
    rows = objects.withColumns({"id": address, "mil_": military_aircraft(address, callsign), "alt_ft": feet, "alt": half_up(feet / FEET),
            "speed": half_up(c("gs")), "type": F.trim(F.coalesce("t", F.lit("")))})
    rows = _taken(rows.withColumn("callsign", F.coalesce(callsign, F.upper(address))),
        [("no_position", c("lat").isNull() | c("lon").isNull()), ("on_ground", grounded), ("not_military", c("mil_").isNull())])
    rows = rows.withColumns({"track": F.coalesce(c("track").cast("double"), F.lit(0.0)), "country": c("mil_.country"),
            "color": c("mil_.color")})
    return rows.select(*AIRCRAFT, "reject")


def reject_counts(rows: DataFrame) -> DataFrame:
    """How many rows were taken by country, and left out by reason."""
    return rows.groupBy(F.coalesce("reject", F.lit("accepted")).alias("outcome"),
        F.when(F.col("reject").isNull(), F.col("country")).alias("country")).agg(F.count("*").alias("n"))


def fused(*sources: DataFrame) -> DataFrame:
    """Accepted rows of all sources, of each id the row of the first source that has it."""
    rows = reduce(lambda a, b: a.unionByName(b), (s.where("reject is null").withColumn("source_", F.lit(i)) for i, s in enumerate(sources)))
    first = Window.partitionBy("id").orderBy("source_", F.col("alt_ft").desc_nulls_last(), "callsign", "lat", "lon")
    return rows.withColumn("rank_", F.row_number().over(first)).where("rank_ = 1").drop("rank_", "source_", "reject")


def air_tracks(aircraft: DataFrame, helicopters: tuple[str, ...] = ()) -> DataFrame:
    """Aircraft as normal tracks."""
    c = F.col
    mil = hex_country(c("id"))
    named = _given(c("callsign"))
    return aircraft.select(
        F.lit("air").alias("domain"), "id", F.coalesce(named, F.upper("id")).alias("name"), F.coalesce(named, F.lit("")).alias("callsign"),
        F.coalesce(F.nullif("country", F.lit("")), mil["country"], F.lit("UNKNOWN")).alias("country"),
            F.coalesce(F.nullif("color", F.lit("")), mil["color"], F.lit("#e8f4ff")).alias("color"),
        "lon", "lat", c("alt").cast("long").alias("alt"), c("alt_ft").cast("long").alias("alt_ft"),
            c("speed").cast("double").alias("speed"), c("track").cast("double").alias("heading"),
        F.coalesce(c("track").cast("double"), F.lit(0.0)).alias("cog"), F.coalesce(c("speed").cast("double"), F.lit(0.0)).alias("sog"),
            helicopter_type(c("type"), helicopters).alias("is_helicopter"),
        mil.isNotNull().alias("military_hex"), (named.isNull() | (named == F.upper("id"))).alias("no_callsign"),
            c("type").alias("craft_type"),
        F.lit(None).cast("int").alias("ship_type"), F.lit(False).alias("warship_number"), F.lit(False).alias("navy_country"),
    )


def as_feed(aircraft: DataFrame) -> DataFrame:
    """Aircraft under the names of the feed that they came from; no activity is null with confidence 0."""
    renamed = {"hex": "id", "flight": "callsign", "lat": "lat", "lon": "lon", "alt_baro": "alt_ft", "gs": "speed", "track": "track",
        "t": "type", "activity": "activity"}
    out = [F.col(old).alias(new) if old in aircraft.columns else F.lit(None).cast("string").alias(new) for new, old in renamed.items()]
    sure = F.coalesce("activity_confidence", F.lit(0.0)) if "activity_confidence" in aircraft.columns else F.lit(0.0)
    return aircraft.select(*out, sure.alias("activity_confidence"))


def shown_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks of the map: aircraft of one common country only where they are surely military."""
    common = (F.col("domain") == "air") & (F.coalesce("country", F.lit("")) == "USA") & (F.coalesce("mil_score", F.lit(0)) != 100)
    return tracks.where(~common)


def sea_tracks(ships: DataFrame) -> DataFrame:
    """Ships (id, name, callsign, country, lon, lat, sog, cog, heading, ship_type, verified) as normal tracks."""
    c = F.col
    number = ship_number(c("id"))
    return ships.select(
        F.lit("sea").alias("domain"), "id", F.coalesce(_given(c("name")), c("id")).alias("name"),
            F.coalesce(_given(c("callsign")), F.lit("")).alias("callsign"),
        F.coalesce(F.nullif("country", F.lit("")), number["country"], F.lit("UNKNOWN")).alias("country"), F.lit("#e8f4ff").alias("color"),
            "lon", "lat",
        F.lit(None).cast("long").alias("alt"), F.lit(None).cast("long").alias("alt_ft"), c("sog").cast("double").alias("speed"),
        F.when(c("heading") != 511, c("heading").cast("double")).alias("heading"),
            F.coalesce(c("cog").cast("double"), F.lit(0.0)).alias("cog"), F.coalesce(c("sog").cast("double"), F.lit(0.0)).alias("sog"),
        F.lit(False).alias("is_helicopter"), F.lit(False).alias("military_hex"), F.lit(False).alias("no_callsign"),
            F.lit(None).cast("string").alias("craft_type"),
        F.coalesce(c("ship_type").cast("int"), F.when(c("verified"), 35)).alias("ship_type"), number["warship"].alias("warship_number"),
            number["country"].isNotNull().alias("navy_country"),
    )


TIERS = {"unknown": 0, "possible": 1, "likely": 2, "confirmed": 3}


def chosen_tracks(tracks: DataFrame, domain: str | None = None, country: str | None = None, least_tier: str | None = None) -> DataFrame:
    """Tracks of a domain, of a country (in any case) and of at least a tier; an unknown tier name keeps all."""
    level = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))
    out = tracks if domain is None else tracks.where(F.col("domain") == domain)
    out = out if country is None else out.where(F.upper("country") == country.upper())
    return out.where(F.coalesce(F.try_element_at(level, F.col("tier")), F.lit(0)) >= TIERS.get(least_tier or "", 0))


def _steady(values: Column, least: int, most: Column) -> Column:
    """Whether an array has enough values, and its population deviation is under a bound that may depend on the mean."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.coalesce((n >= least) & (F.sqrt(var) < most(mean)), F.lit(False))


def air_activity(reports: DataFrame, entity: str = "entity", points: int = 30) -> DataFrame:
    """Activity and confidence of each aircraft from its newest reports: by type (AWACS, TANKER, ISR), else by behaviour (CAP).

    ``reports``: entity, ts_us, seq, lat, lon, heading, speed, alt_ft, craft_type. The newest report gives type and altitude.
    """
    c = F.col
    recent = last_points(reports, points, entity)
    path = F.array_sort(F.collect_list(F.struct("ts_us", "seq", "lat", "lon", "heading", "speed", "alt_ft", "craft_type")))
    rows = recent.groupBy(entity).agg(path.alias("path"))
    n, last = F.size("path"), F.element_at("path", -1)
    numbers = F.sequence(F.lit(2), F.greatest(F.lit(2), n))
    turned = F.aggregate(F.filter(numbers, lambda i: i <= n), F.lit(0.0), lambda a,
        i: a + F.coalesce(turn(F.element_at("path", i - 1)["heading"], F.element_at("path", i)["heading"]), F.lit(0.0)))
    mean_of = lambda f: F.aggregate("path", F.lit(0.0), lambda a, p: a + f(p)) / n
    rows = rows.withColumns({"n": n, "last": last, "turned": F.abs(turned), "mid_lat": mean_of(lambda p: p["lat"]),
            "mid_lon": mean_of(lambda p: p["lon"])})
    radii = F.transform("path", lambda p: haversine(p["lat"], p["lon"], c("mid_lat"), c("mid_lon")))
    rows = rows.withColumn("radii", radii).withColumn("mean_km", F.aggregate("radii", F.lit(0.0), lambda a, v: a + v) / c("n"))
    circle = _steady(c("radii"), 1, lambda mean: mean * 0.25) & (c("mean_km") > 5) & (c("turned") > 90)
    speeds = F.filter(F.transform("path", lambda p: p["speed"].cast("double")), lambda v: v > 50)
    alts = F.filter(F.transform("path", lambda p: p["alt_ft"].cast("double")), lambda v: v > 0)
    kind = F.upper(F.trim(F.coalesce("last.craft_type", F.lit(""))))
    rows = rows.withColumns({
        "orbit": (c("n") >= 8) & ((c("turned") >= 270) | circle), "even_speed": _steady(speeds, 4, lambda mean: mean * 0.10),
            "even_alt": _steady(alts, 4, lambda _: F.lit(2000.0)),
        "kind": kind, "alt": c("last.alt_ft"), "elapsed": F.element_at("path", -1)["ts_us"] - F.element_at("path", 1)["ts_us"],
    })
    yes = lambda x, points: F.when(F.coalesce(x, F.lit(False)), points).otherwise(0)
    two_places = lambda points, most: F.floor(F.least(points / F.lit(float(most)), F.lit(1.0)) * 100 + 0.5) / 100
    awacs = 60 + yes(c("alt").between(28000, 40000), 20) + yes(c("even_speed"), 10) + yes(c("orbit"), 25)
    tanker = 60 + yes(c("alt").between(18000, 32000), 20) + yes(c("even_speed"), 15)
    isr = 60 + yes(c("alt") >= 20000, 15) + yes(c("n") >= 15, 10) + yes(c("orbit"), 20)
    cap = 40 + yes(c("even_alt"), 20) + yes(c("even_speed"), 20) + yes((c("n") >= 2) & (c("elapsed") >= 20 * 60 * 1_000_000), 20)
    typed = (
        F.when(c("kind").isin(*AWACS), F.struct(F.lit("AWACS").alias("activity"), two_places(awacs, 115).alias("confidence")))
        .when(c("kind").isin(*TANKER), F.struct(F.lit("TANKER").alias("activity"), two_places(tanker, 95).alias("confidence")))
        .when(c("kind").isin(*ISR), F.struct(F.lit("ISR").alias("activity"), two_places(isr, 105).alias("confidence")))
    )
    patrol = F.when(c("orbit") & (cap >= 50), F.struct(F.lit("CAP").alias("activity"), two_places(cap, 100).alias("confidence")))
    rows = rows.withColumn("found", F.coalesce(typed, patrol))
    return rows.select(entity, "orbit", "even_speed", "even_alt", c("found.activity").alias("activity"),
        F.coalesce("found.confidence", F.lit(0.0)).alias("confidence"))


def verified_ships(messages: DataFrame) -> DataFrame:
    """Positions of ships that were shown to be military by then.

    ``messages``: number (text), ts_us, seq, kind (static or position), name, ship_type, lat, lon. A ship is shown by a
    static message with a military name or type 35 before or with the position, or by a warship's number.
    """
    c = F.col
    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), "@+$", ""))
    shown = (c("kind") == "static") & (name.rlike(SHIP_NAME) | F.coalesce(c("ship_type") == 35, F.lit(False)))
    path = Window.partitionBy("number").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("shown_name", F.last(F.when(shown, F.coalesce(F.nullif(name, F.lit("")), c("number"))),
            ignorenulls=True).over(path))
    rows = rows.where((c("kind") == "position") & valid_position(c("lat"), c("lon")))
    own = ship_number(c("number"))
    return rows.withColumn("own_", own).where(c("shown_name").isNotNull()
        | c("own_.warship")).withColumns({"ship": F.coalesce("shown_name", "number"), "country": c("own_.country")}).drop("own_")
