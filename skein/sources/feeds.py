"""Readers of delimited event feeds, manifests, RSS items and line JSON, each with an explicit schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import lenient
from ..functions.text import decode_entities

# Positions of the fields in the public event export of 61 columns.
EVENT_FIELDS = {
    "id": 0, "date": 1, "actor1": 6, "actor2": 16, "code": 26, "root": 28, "quad_class": 29, "goldstein": 30, "mentions": 31, "sources": 32,
    "articles": 33, "tone": 34, "geo_type": 51, "location": 52, "country": 53, "lat": 56, "lon": 57, "added": 59, "url": 60,
}
NUMBERS = ("goldstein", "mentions", "sources", "articles", "tone", "lat", "lon")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated event files that have all fields, a url and a place other than (0, 0)."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 61)
    columns = {n: F.trim(parts[i]) for n, i in EVENT_FIELDS.items()}
    out = rows.select(*((lenient(c) if n in NUMBERS else c).alias(n) for n, c in columns.items()))
    placed = ~F.isnan("lat") & ~F.isnan("lon") & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return out.where(placed & (F.col("url") != ""))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ts, events, mentions, gkg): the batches of a file list that have all three kinds; a later line wins."""
    url = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    lines = spark.read.text(path).select(url.alias("url"), F.monotonically_increasing_id().alias("line"))
    file = F.element_at(F.split("url", "/"), -1)
    kind = F.when(file.rlike(r"(?i)\.export\.csv\.zip$"), "events").when(file.rlike(r"(?i)\.mentions\.csv\.zip$"),
        "mentions").when(file.rlike(r"(?i)\.gkg\.csv\.zip$"), "gkg")
    known = lines.select(F.regexp_extract(file, r"^(\d{14})\.", 1).alias("ts"), kind.alias("kind"), "url",
        "line").where("ts <> '' and kind is not null")
    kinds = ["events", "mentions", "gkg"]
    wide = known.groupBy("ts").pivot("kind", kinds).agg(F.max_by("url", "line"))
    return wide.dropna(subset=kinds)


def read_manifests(spark: SparkSession, paths: dict[str, str | None]) -> DataFrame:
    """Batches of several file lists, with ``feed`` naming each; a list without a path, or that isn't there, is left out."""
    found = None
    for feed, path in paths.items():
        if path is None or not _is_there(spark, path):
            continue
        rows = read_manifest(spark, path).withColumn("feed", F.lit(feed))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], "ts string, events string, mentions string, gkg string, feed string") if found is None else found


def _is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


class Optional:
    """A feed that a run can do without: after ``most`` batches without it, the rest of the run no longer looks for it."""

    def __init__(self, spark: SparkSession, most: int = 1):
        self.spark, self.most, self.missed = spark, most, 0

    @property
    def out(self) -> bool:
        return self.missed >= self.most

    def read(self, path: str | None, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame | None:
        """The rows of a batch's file, None where it isn't there or the feed is out for this run."""
        if path is None or self.out:
            return None
        if not _is_there(self.spark, path):
            self.missed += 1
            return None
        self.missed = 0
        return read(self.spark, path)


#: Positions of the fields in the public mention feed.
MENTION_FIELDS = {"event_id": 0, "seen_at": 2, "identifier": 5, "confidence": 11, "tone": 13}


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated mention files with 14 fields at least and an event, in their order (seq); what is no number is null."""
    parts = F.split("value", "\t", -1)
    at = lambda n: F.trim(parts[MENTION_FIELDS[n]])
    rows = spark.read.text(path).where(F.size(parts) >= 14)
    number = lambda n: F.when(~F.isnan(at(n).try_cast("double")), at(n).try_cast("double")).alias(n)
    out = rows.select(at("event_id").alias("event_id"), at("seen_at").alias("seen_at"),
        F.nullif(at("identifier"), F.lit("")).alias("identifier"), number("confidence"), number("tone"),
        F.monotonically_increasing_id().alias("seq"))
    return out.where("event_id <> ''")


def pending(batches: DataFrame, mark: str | None, most: int = 8, first_run: int = 48) -> DataFrame:
    """Batches after the mark, or the newest on a first run; the oldest ``most`` of them."""
    if mark:
        return batches.where(F.col("ts") > mark).orderBy("ts").limit(most)
    return batches.orderBy(F.desc("ts")).limit(first_run).orderBy("ts").limit(most)


def rss_items(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per item with a title of the RSS documents, beside their other columns."""
    items = documents.withColumn("item", F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item[ >](.*?)</item>"), F.lit(1)))).drop(xml)

    def tag(name: str):
        found = F.regexp_extract("item", rf"(?s)<{name}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1)
        return F.trim(decode_entities(found))

    source_url = F.regexp_extract("item", r'<source[^>]*\burl="([^"]*)"', 1)
    out = items.withColumns({"title": tag("title"), "link": tag("link"), "published": tag("pubDate"), "source": tag("source"),
            "source_url": source_url})
    return out.drop("item").where(F.col("title") != "")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line JSON without the lines that don't parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
