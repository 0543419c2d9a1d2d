"""Quakes, launches, re-entries, space weather, vessel anomalies and conflict records as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import grid
from ..functions.numbers import half_up

# Colours by alert, magnitude and urgency, points by kind.
ALERT_COLORS = {"red": "#ff2244", "orange": "#ff6600", "yellow": "#ffaa00"}
STATUS_COLORS = {1: "#00ff88", 2: "#ffaa00", 3: "#00d4ff", 4: "#ff2244"}
ANOMALY_KINDS = (("gap", "dark_shipping", 80), ("encounter", "vessel_encounter", 70), ("loiter", "loitering", 65),
    ("fishing", "fishing_activity", 50), ("port", "port_visit", 40))
OTHER_ANOMALY = ("maritime_anomaly", 55)
LONGEST_DAYS = 365
TONES = ((20, -10), (10, -8), (5, -6), (1, -4))
OTHER_TONE = -2


def _or(x: Column, other) -> Column:
    return F.coalesce(x, F.lit(other))


def quake_color(mag: Column, alert: Column) -> Column:
    """By alert where there is one, else by magnitude."""
    out = F.when(mag >= 7, "#ff2244").when(mag >= 6, "#ff6600").when(mag >= 5, "#ffaa00").otherwise("#ffdd55")
    for name, color in ALERT_COLORS.items():
        out = F.when(alert == name, color).otherwise(out)
    return out


# Colours of the planetary index and of the storm scales, sizes and least strength of quakes on the map.
KP_COLORS, SCALE_COLORS = ((7, "#ff2244"), (5, "#ff6600"), (4, "#ffaa00"), (3, "#ffdd55")), ((4, "#ff2244"), (3, "#ff6600"),
    (2, "#ffaa00"), (1, "#ffdd55"))
UNKNOWN_COLOR, CALM_COLOR, LEAST_SHOWN = "#2a4a5a", "#00ff88", 5.5


def _stepped(x: Column, steps: tuple, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for least, color in reversed(steps):
        out = F.when(x >= least, color).otherwise(out)
    return out


def kp_color(kp: Column) -> Column:
    return F.when(kp.isNull(), UNKNOWN_COLOR).otherwise(_stepped(kp, KP_COLORS, CALM_COLOR))


def scale_color(level: Column) -> Column:
    return _stepped(_or(level, 0), SCALE_COLORS, UNKNOWN_COLOR)


def shown_quakes(rows: DataFrame, least: float = LEAST_SHOWN) -> DataFrame:
    """Quakes that are strong enough for the map, with the radius of their mark."""
    return rows.where(F.col("mag") >= least).withColumn("radius",
        F.when(F.col("mag") >= 7.5, 22).when(F.col("mag") >= 6.5, 14).otherwise(8))


def quakes(features: DataFrame) -> DataFrame:
    """Flat rows of features (id, properties, geometry); what is missing is 0 or empty."""
    p, at = (lambda n: F.col(f"properties.{n}")), (lambda i: _or(F.get("geometry.coordinates", F.lit(i)), 0.0))
    mag = _or(p("mag"), 0.0)
    name = F.coalesce("id", F.concat_ws("_", at(1).cast("string"), at(0).cast("string"), p("time").cast("string")))
    return features.select(
        name.alias("id"), mag.alias("mag"), _or(p("place"), "").alias("place"), F.timestamp_millis(p("time")).alias("time"),
            at(2).alias("depth"), at(1).alias("lat"), at(0).alias("lon"),
        (_or(p("tsunami"), 0) != 0).alias("tsunami"), p("alert").alias("alert"), _or(p("url"), "").alias("url"),
            _or(p("sig"), 0).alias("sig"), quake_color(mag, p("alert")).alias("color"),
    )


def launches(raw: DataFrame) -> DataFrame:
    """Flat launches of nested rows, with defaults for what is missing."""
    c = F.col
    color = F.create_map(*(F.lit(x) for pair in STATUS_COLORS.items() for x in pair))
    more = {
        "window_start": "window_start", "window_end": "window_end", "status.name": "status_text",
            "launch_service_provider.type.name": "provider_type", "mission.type": "mission_type",
        "mission.description": "mission_text", "pad.country.name": "pad_country", "failreason": "failure",
    }
    return raw.select(
        "id", _or(c("name"), "Unknown Mission").alias("name"), "net", _or(c("status.id"), 0).alias("status"),
            _or(c("status.abbrev"), "?").alias("status_label"),
        _or(F.try_element_at(color, c("status.id")), "#4a6a7a").alias("status_color"),
            _or(c("launch_service_provider.name"), "Unknown").alias("provider"),
        F.coalesce(F.nullif(c("rocket.configuration.full_name"), F.lit("")), F.nullif(c("rocket.configuration.name"), F.lit("")),
            F.lit("Unknown")).alias("rocket"),
        _or(c("mission.name"), "").alias("mission"), _or(c("mission.orbit.name"), "").alias("orbit"), _or(c("pad.name"), "").alias("pad"),
            _or(c("pad.latitude").try_cast("double"), 0.0).alias("lat"),
        _or(c("pad.longitude").try_cast("double"), 0.0).alias("lon"),
            F.coalesce(c("image.thumbnail_url"), c("image.image_url")).alias("image"), _or(c("webcast_live"), False).alias("webcast_live"),
        *(_or(c(path), "").alias(name) for path, name in more.items()),
    )


def launch_events(raw: DataFrame) -> DataFrame:
    """Flat events around launches, with defaults for what is missing."""
    c = F.col
    image = F.coalesce(F.nullif(c("image.thumbnail_url"), F.lit("")), F.nullif(c("image.image_url"), F.lit("")))
    return raw.select(
        "id", F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown Event")).alias("name"), F.nullif("date", F.lit("")).alias("date"),
            _or(c("type.name"), "").alias("type"),
        _or(c("location"), "").alias("location"), _or(c("description"), "").alias("description"), image.alias("image"),
            _or(c("webcast_live"), False).alias("webcast_live"),
    )


def pads(upcoming: DataFrame, previous: DataFrame) -> DataFrame:
    """Different pads by place to three decimals: the last upcoming launch names a pad, else the first previous one.

    Both: pad, lat, lon, ord.
    """
    key = F.concat_ws(",", *(F.format_string("%.3f", c) for c in ("lat", "lon")))
    rows = upcoming.select("pad", "lat", "lon", "ord", F.lit(True).alias("up")).unionByName(
        previous.select("pad", "lat", "lon", "ord", F.lit(False).alias("up")))
    rows = rows.where("lat <> 0 and lon <> 0").withColumn("place", key)
    choice = F.struct("up", F.when(F.col("up"), F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    return rows.groupBy("place").agg(F.max_by("pad", choice).alias("pad"), F.max_by("lat", choice).alias("lat"),
        F.max_by("lon", choice).alias("lon"), F.bool_or("up").alias("has_upcoming"))


def launch_at(places: DataFrame, rows: DataFrame, degrees: float = 0.05) -> DataFrame:
    """(place, launch): the first launch within a box around each place. Cells of the box's size meet their neighbours only."""
    cell = lambda x: F.floor(x / degrees).cast("long")
    around = lambda x: F.explode(F.array(cell(x) - 1, cell(x), cell(x) + 1))
    a = places.withColumn("row_", around(F.col("lat"))).withColumn("cell_", around(F.col("lon")))
    b = rows.select(F.col("id").alias("launch"), F.col("ord").alias("launch_ord"), F.col("lat").alias("launch_lat"),
        F.col("lon").alias("launch_lon"))
    b = b.withColumns({"row_": cell(F.col("launch_lat")), "cell_": cell(F.col("launch_lon"))})
    near = a.join(b, ["row_", "cell_"]).where((F.abs(F.col("lon") - F.col("launch_lon")) < degrees)
        & (F.abs(F.col("lat") - F.col("launch_lat")) < degrees))
    return near.groupBy("place").agg(F.min_by("launch", "launch_ord").alias("launch"))


def _urgency(left: Column, steps: tuple[float, float, float]) -> Column:
    return F.when(left < steps[0], "#ff2244").when(left < steps[1], "#ff6600").when(left < steps[2], "#ffaa00").otherwise("#ffdd55")


def _numbers(*names: str) -> list[Column]:
    return [_or(F.col(n).try_cast("double"), 0.0).alias(n.lower()) for n in names]


def _ahead(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows without a stated decay, or one that is at most six hours past."""
    epoch = F.to_timestamp("DECAY_EPOCH")
    return rows.withColumn("decay", epoch).where(F.col("decay").isNull() | (F.col("decay") >= as_of - F.expr("INTERVAL 6 HOURS")))


def decays(rows: DataFrame, countries: DataFrame, as_of: Column) -> DataFrame:
    """Decaying objects at the centre of their country (code, lat, lon), shifted by up to 4 degrees by a hash of the id; unknown countries go.

    Without a decay date there are no days left to tell, and the least urgent colour.
    """
    c = F.col
    out = _ahead(rows.withColumn("country", _or(F.nullif("COUNTRY_CODE", F.lit("")), "INTL")), as_of)
    out = out.join(countries.select(c("code").alias("country"), c("lat").alias("mid_lat"), c("lon").alias("mid_lon")), "country")
    days = F.when(c("decay").isNotNull(), F.greatest(F.lit(0.0), (F.unix_seconds("decay") - F.unix_seconds(as_of)) / 86400.0))
    drawn = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), _or(c("NORAD_CAT_ID"), ""))), 1, 8), 16, 10).cast("double")
    shift = lambda salt: (drawn(salt) / F.lit(4294967296.0) - 0.5) * 8
    return out.withColumn("days_left", days).select(
        _or(c("NORAD_CAT_ID"), "unknown").alias("id"), F.coalesce("OBJECT_NAME", F.concat(F.lit("NORAD "), "NORAD_CAT_ID")).alias("name"),
            "country", *_numbers("WINDOW", "INCLINATION", "APOGEE", "PERIGEE"),
        _or(c("OBJECT_ID"), "").alias("object_id"), c("DECAY_EPOCH").alias("decay_epoch"), c("MSG_EPOCH").alias("msg_epoch"), "days_left",
            _urgency(c("days_left"), (3, 7, 14)).alias("color"), (c("mid_lat") + shift("a")).alias("lat"),
            (c("mid_lon") + shift("o")).alias("lon"),
    )


def reentries(rows: DataFrame, as_of: Column) -> DataFrame:
    """Predicted re-entries at their own place; rows without one go."""
    c = F.col
    out = _ahead(rows.withColumns({"lat": c("LAT").try_cast("double"), "lon": c("LON").try_cast("double")}).where(
            "lat is not null and lon is not null"), as_of)
    out = out.withColumn("hours_left", (F.unix_seconds("decay") - F.unix_seconds(as_of)) / 3600.0)
    return out.select(
        _or(c("NORAD_CAT_ID"), "unknown").alias("id"), F.coalesce("OBJECT_NAME", F.concat(F.lit("NORAD "), "NORAD_CAT_ID")).alias("name"),
            _or(F.nullif("COUNTRY_CODE", F.lit("")), "INTL").alias("country"),
        _or(c("HIGH_INTEREST") == "Y", False).alias("high_interest"), "hours_left", _urgency(c("hours_left"), (6, 24, 72)).alias("color"),
            "lat", "lon",
    )


def vessel_events_in(rows: DataFrame, as_of: Column, days: int = 90, most: int = 99) -> DataFrame:
    """Events that begin on one of the last days, newest first; at most ``most``, as the source's own page."""
    day = F.to_date("start")
    return rows.where((day >= F.date_sub(F.to_date(as_of), days)) & (day <= F.to_date(as_of))).orderBy(F.desc("start"), "ord").limit(most)


def soonest(objects: DataFrame, left: str, otherwise: float) -> DataFrame:
    """In order of the time left, unknown ones as if it were ``otherwise``."""
    return objects.orderBy(F.coalesce(F.col(left), F.lit(otherwise)), "id")


def headline(message: Column) -> Column:
    """The first line that is neither a code nor an issue time, else the first; at most 120 characters."""
    lines = F.filter(F.transform(F.split(_or(message, ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(lines, lambda x: ~x.startswith("Space Weather Message Code") & ~x.startswith("Issue Time"))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), 1, 120)


def space_weather(scales: DataFrame, kp: DataFrame, alerts: DataFrame, as_of: Column, most: int = 8) -> DataFrame:
    """One row: scales g, s and r, the newest kp, and the first eight alerts of the last 48 hours (ord is their order).

    ``kp``: time, kp as text; ``alerts``: product_id, issued, message, ord.
    """
    newest = kp.agg(F.max_by(F.nullif(F.col("kp").try_cast("double"), F.lit(0.0)), "time").alias("kp"))
    first = alerts.where(F.col("issued") > as_of - F.expr("INTERVAL 48 HOURS")).orderBy("ord").limit(most)
    told = F.struct("ord", F.coalesce("product_id", F.col("issued").cast("string")).alias("id"), "issued",
        headline(F.col("message")).alias("headline"))
    listed = first.agg(F.array_sort(F.collect_list(told)).alias("alerts"))
    today = scales.agg(*(_or(F.max(F.col(x).try_cast("int")), 0).alias(x) for x in ("g", "s", "r")))
    return today.join(F.broadcast(newest)).join(F.broadcast(listed))


def vessel_anomalies(raw: DataFrame) -> DataFrame:
    """Anomalies of vessel events (id, type, lat, lon, start, end, vessel_id, ord) that last at most a year; of equal kind, cell and vessel the surest, first."""
    c = F.col
    text, kind, sure = F.lower(_or(c("type"), "")), F.lit(OTHER_ANOMALY[0]), F.lit(OTHER_ANOMALY[1])
    for word, name, points in reversed(ANOMALY_KINDS):
        kind, sure = F.when(text.contains(word), name).otherwise(kind), F.when(text.contains(word), points).otherwise(sure)
    minutes = half_up((F.unix_seconds("end") - F.unix_seconds("start")) / 60.0)
    rows = raw.where("lat is not null and lon is not null").withColumns({"kind": kind, "confidence": sure, "minutes": minutes})
    rows = rows.where(c("minutes").isNull() | (c("minutes") <= LONGEST_DAYS * 24 * 60))
    key = [c("kind"), half_up(c("lat") * 10), half_up(c("lon") * 10), _or(c("vessel_id"), "")]
    best = Window.partitionBy(*key).orderBy(F.desc("confidence"), "ord")
    name = F.coalesce(c("id").cast("string"), F.concat(F.lit("gfw-"), "kind", F.lit("-"), c("ord").cast("string")))
    return rows.withColumn("rank_", F.row_number().over(best)).where("rank_ = 1").select(name.alias("id"), "kind", "confidence", "minutes",
        "lat", "lon", "vessel_id", F.coalesce("start", "end").alias("seen"))


def conflict_records(rows: DataFrame, first_day: Column, last_day: Column, most: int = 500) -> DataFrame:
    """Records of a range of days with tone and score by fatalities and a short title; at most ``most``, a report's cap.

    ``rows``: id, day, kind, sub_kind, actor1, country, fatalities, notes.
    """
    c = F.col
    dead, tone = _or(c("fatalities"), 0), F.lit(OTHER_TONE)
    for least, points in reversed(TONES):
        tone = F.when(dead >= least, points).otherwise(tone)
    text = F.coalesce(F.nullif(F.trim("notes"), F.lit("")), F.concat_ws(" - ", "sub_kind", "country"))
    title = F.when(F.length(text) > 180, F.concat(F.substring(text, 1, 177), F.lit("..."))).otherwise(text)
    out = rows.where(c("day").between(first_day, last_day)).orderBy(F.desc("day"), "id").limit(most)
    return out.select("id", "day", title.alias("title"), tone.alias("tone"), (F.lit(100) + 5 * dead).alias("score"))


def countdown(minutes: Column) -> Column:
    """T- days, hours and minutes, or LAUNCHED once the time is past."""
    days, hours, rest = (minutes / 1440).cast("int"), (minutes / 60).cast("int") % 24, minutes % 60
    return F.when(minutes < 0, "LAUNCHED").when(days > 0,
        F.format_string("T-%dd %02d:%02d", days, hours, rest.cast("int"))).otherwise(
        F.format_string("T-%02d:%02d", hours, rest.cast("int")))


def spread(points: DataFrame, ring: float = 0.18) -> DataFrame:
    """Points (id, lat, lon) of one place, to two decimals, dealt out on a ring; single ones stay. Adds n and place number."""
    key = [half_up(F.col("lat") * 100), half_up(F.col("lon") * 100)]
    own, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("id")
    rows = points.withColumns({"n": F.count("*").over(own), "at": F.row_number().over(order) - 1})
    angle = F.col("at") * (2 * 3.141592653589793) / F.col("n")
    moved = lambda c, f: F.when(F.col("n") > 1, F.col(c) + f(angle) * ring).otherwise(F.col(c))
    return rows.withColumns({"map_lat": moved("lat", F.sin), "map_lon": moved("lon", F.cos)})


GOLDEN_ANGLE = 137.5


def spiral(points: DataFrame, digits: int, step: float, order: str = "id") -> DataFrame:
    """Points of one place, to some decimals, on a golden-angle spiral in their order: the first stays, each six more lie a step further out.

    Adds place number and map place. Only the points of one place come together, and only in their order.
    """
    key = [half_up(F.col("lat") * 10**digits), half_up(F.col("lon") * 10**digits)]
    rows = points.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1)
    angle, radius = F.radians(F.col("at") * F.lit(GOLDEN_ANGLE)), F.ceil(F.col("at") / 6) * F.lit(step)
    moved = lambda c, f: F.when(F.col("at") > 0, F.col(c) + radius * f(angle)).otherwise(F.col(c))
    return rows.withColumns({"map_lat": moved("lat", F.cos), "map_lon": moved("lon", F.sin)})


def geojson(points: DataFrame, *properties: str) -> DataFrame:
    """One feature of each point as a JSON line, placed by ``map_lon`` and ``map_lat``."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("map_lon", "map_lat").alias("coordinates"))
    return points.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                F.struct(*properties).alias("properties"))).alias("feature"))


def cell_counts(points: DataFrame, size: int) -> DataFrame:
    """Points by cell, with each cell's share of the fullest (of one at least)."""
    cells = points.groupBy(grid(F.col("lat"), size).alias("cell_lat"),
        grid(F.col("lon"), size).alias("cell_lon")).agg(F.count("*").alias("n"))
    most = cells.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    return cells.join(F.broadcast(most)).withColumn("share", F.col("n") / F.col("most")).drop("most")
