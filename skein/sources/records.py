"""Readers of zipped feeds, document feeds, JSON records of quakes, launches, re-entries, aircraft and ships, each with its schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_number, split_list

QUAKES = "features array<struct<id string, properties struct<mag double, place string, time long, tsunami int, alert string, url string, sig long>, geometry struct<coordinates array<double>>>>"
LAUNCHES = (
    "results array<struct<id string, name string, net string, window_start string, window_end string, status struct<id int, abbrev string, name string>, "
    "launch_service_provider struct<name string, type struct<name string>>, rocket struct<configuration struct<full_name string, name string>>, "
    "mission struct<name string, type string, orbit struct<name string>, description string>, pad struct<name string, latitude string, longitude string, country struct<name string>>, "
    "image struct<thumbnail_url string, image_url string>, webcast_live boolean, failreason string>>"
)
LAUNCH_EVENTS = (
    "results array<struct<id string, name string, date string, type struct<name string>, location string, description string, image struct<thumbnail_url string, image_url string>, webcast_live boolean>>"
)
#: What one page of each of the source's three lists holds.
UPCOMING, PREVIOUS, EVENTS_AHEAD = 20, 5, 15
OBJECTS = "NORAD_CAT_ID string, OBJECT_NAME string, OBJECT_ID string, DECAY_EPOCH string, WINDOW string, INCLINATION string, APOGEE string, PERIGEE string, COUNTRY_CODE string, MSG_EPOCH string, LAT string, LON string, HIGH_INTEREST string, DIRECTION string, OBJECT_TYPE string"
AIRCRAFT = "ac array<struct<hex string, flight string, r string, t string, lat double, lon double, alt_baro string, on_ground boolean, gs double, track double>>"
STATES = "states array<array<string>>"
SHIPS = (
    "MessageType string, MetaData struct<MMSI long, latitude double, longitude double, time_utc string>, "
    "Message struct<PositionReport: struct<Longitude double, Latitude double, Cog double, Sog double, TrueHeading double>, ShipStaticData: struct<Name string, CallSign string, Type int>>"
)
VESSELS = "entries array<struct<id string, type string, start timestamp, `end` timestamp, position struct<lat double, lon double>, vessel struct<id string, ssvid string>>>"


def read_zipped(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """(path, line): the lines of the first file of each zip file; a file that isn't one gives no lines.

    With ``errors`` also error, and such a file gives one row with the reason and no line.
    """

    names = ["path", "line", "error"] if errors else ["path", "line"]

    def told(name: str, held: list[str]) -> pa.RecordBatch:
        columns = [pa.array([name] * len(held)), pa.array(held), *([pa.nulls(len(held), pa.string())] if errors else [])]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                        held: list[str] = []
                        for line in io.TextIOWrapper(f, "utf-8", "replace", newline="\n"):
                            held.append(line.rstrip("\r\n"))
                            if len(held) == 10_000:
                                yield told(name, held)
                                held = []
                except (zipfile.BadZipFile, IndexError) as e:
                    if errors:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.string()), pa.array([str(e) or "empty"])],
                            names)
                    continue
                if held:
                    yield told(name, held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, line string" + (", error string" if errors else ""))


#: Columns of the public document feed (from 0): address, pairs of lists of which the second is fuller, tone, extras.
DOCUMENT_COLUMNS = {"address": 4, "themes": (8, 7), "locations": (10, 9), "persons": (12, 11), "organizations": (14, 13), "tone": 15,
    "extras": 26}


def documents_of_lines(lines: DataFrame, line: str = "line", columns: dict = DOCUMENT_COLUMNS) -> DataFrame:
    """Documents of tab-separated lines with 16 fields at least; a list is the fuller column's, else the one before it. The last row of an address counts."""
    parts = F.split(F.col(line), "\t", -1)
    at: Column = lambda i: F.trim(F.coalesce(F.get("parts_", F.lit(i)), F.lit("")))  # type: ignore[assignment]
    rows = lines.withColumns({"parts_": parts, "seq": F.monotonically_increasing_id()}).where(F.size("parts_") >= 16)
    lists = {n: split_list(F.coalesce(F.nullif(at(i[0]), F.lit("")), at(i[1]))) for n, i in columns.items() if isinstance(i, tuple)}
    out = rows.select(at(columns["address"]).alias("address"), "seq", *(c.alias(n) for n, c in lists.items()),
        first_number(at(columns["tone"])).alias("tone"), at(columns["extras"]).alias("extras"))
    out = out.where("address <> ''")
    fields = [c for c in out.columns if c not in ("address", "seq")]
    last = out.groupBy("address").agg(F.max_by(F.struct(*fields), "seq").alias("d"))
    return last.select("address", *(F.col(f"d.{c}").alias(c) for c in fields))


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_quakes(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, QUAKES).select(F.inline("features"))


def read_launches(spark: SparkSession, path: str) -> DataFrame:
    """Launches of a page, upcoming or previous, in its order (ord)."""
    return _whole(spark, path, LAUNCHES).select(F.posexplode("results").alias("ord", "r")).select("ord", "r.*")


def read_launch_events(spark: SparkSession, path: str) -> DataFrame:
    """Events around launches of a page, in its order (ord)."""
    return _whole(spark, path, LAUNCH_EVENTS).select(F.posexplode("results").alias("ord", "r")).select("ord", "r.*")


def read_objects(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, most: int = 100) -> DataFrame:
    """Decaying objects in the order of their epoch, of a range of epochs; at most ``most``, as the source's own page."""
    rows = _whole(spark, path, OBJECTS)
    rows = rows if first is None else rows.where(F.col("DECAY_EPOCH") >= first)
    rows = rows if last is None else rows.where(F.col("DECAY_EPOCH") <= last)
    return rows.orderBy("DECAY_EPOCH", "NORAD_CAT_ID").limit(most)


def read_aircraft(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, AIRCRAFT).select(F.inline("ac"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, STATES).select(F.explode("states").alias("state"))


def read_vessel_events(spark: SparkSession, path: str) -> DataFrame:
    rows = _whole(spark, path, VESSELS).select(F.posexplode("entries").alias("ord", "e"))
    return rows.select("ord", "e.id", "e.type", "e.start", "e.end", F.col("e.position.lat").alias("lat"),
        F.col("e.position.lon").alias("lon"), F.coalesce("e.vessel.id", "e.vessel.ssvid").alias("vessel_id"))


def ship_messages(messages: DataFrame) -> DataFrame:
    """Messages of both kinds as rows of (number, ts, kind, name, ship_type, lat, lon, cog, sog, heading)."""
    p, s, m = "Message.PositionReport.", "Message.ShipStaticData.", "MetaData."
    kind = F.when(F.col("MessageType") == "ShipStaticData", "static").when(F.col("MessageType") == "PositionReport", "position")
    heading = F.when(F.col(p + "TrueHeading") != 511, F.col(p + "TrueHeading"))
    return messages.select(
        F.col(m + "MMSI").cast("string").alias("number"), F.try_to_timestamp(F.col(m + "time_utc")).alias("ts"), kind.alias("kind"),
            F.col(s + "Name").alias("name"), F.col(s + "Type").alias("ship_type"),
        F.coalesce(p + "Latitude", m + "latitude").alias("lat"), F.coalesce(p + "Longitude", m + "longitude").alias("lon"),
            F.coalesce(p + "Cog", F.lit(0.0)).alias("cog"), F.coalesce(p + "Sog", F.lit(0.0)).alias("sog"), heading.alias("heading"),
    ).where("kind is not null and number <> ''")


def enveloped(documents: DataFrame, keys: tuple[str, ...], column: str = "json") -> DataFrame:
    """One row (ord, entry as JSON) per entry of documents that are a list or hold one under the first of the keys that is there.

    An empty list under a key counts as there. A document that is neither, or can't be read, has no entries.
    """
    v = F.try_parse_json(column)
    entries = F.coalesce(*(F.try_variant_get(v, path, "array<variant>") for path in ("$", *(f"$.{k}" for k in keys))))
    return documents.select(*(c for c in documents.columns if c != column),
        F.posexplode(entries).alias("ord", "entry")).withColumn("entry", F.to_json("entry"))


def with_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """News items with the domain, label and hinted place of their feed (feed, feed_domain, feed_label, hint), left as they are where it isn't known."""
    return items.join(feeds, "feed", "left")
