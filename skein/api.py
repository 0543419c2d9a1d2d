"""Named views over the engine's tables: what a service would serve, each a DataFrame with a bounded number of rows.

A view is (spark, tables) -> DataFrame, where ``tables`` names DataFrames; what a view needs and is not there gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rollups

#: The most rows that a view gives, and its usual number: a service's page, not a cap on what is computed.
MOST, USUAL = 1000, 200


@dataclass(frozen=True)
class View:
    table: str
    order: tuple[str, ...]
    usual: int = USUAL
    columns: tuple[str, ...] = ()


#: The views of single tables: the table, its order (a leading - is descending) and the shown columns (all where empty).
VIEWS = {
    "events": View("events", ("-score", "id"), 800), "osint": View("events", ("-score", "id")),
        "decay": View("decay", ("days_left", "id")), "tip": View("tip", ("hours_left", "id")),
    "launches": View("launches", ("net", "id"), 20), "previous_launches": View("previous", ("-net", "id"), 5),
        "pads": View("pads", ("place",)), "earthquakes": View("quakes", ("-time", "id")),
    "space_weather": View("space_weather", ("g",), 1), "military_aircraft": View("aircraft", ("id",)),
        "military_ships": View("ships", ("id",)), "tracks": View("tracks", ("-score", "id")),
    "world_events": View("world_events", ("id",)), "signal_markers": View("signal_markers", ("id",)),
        "news": View("news", ("-ts", "id"), 500), "news_for_map": View("news_map", ("-ts", "id"), 500),
    "maritime_events": View("maritime", ("-confidence", "id")), "maritime_anomalies": View("anomalies", ("-confidence", "id"), 500),
        "naval_activity": View("naval", ("-boosted", "id")),
    "aviation_events": View("aviation", ("-confidence", "id")), "spatial_events": View("spatial", ("-confidence", "id")),
        "signals": View("clusters", ("-n", "cell_lat", "cell_lon"), 30),
    "review": View("labels", ("-collected_at", "event_id"), 200, ("event_id", "keep", "review_flags", "collected_at")),
}


def page_size(asked: object, usual: int = USUAL, most: int = MOST) -> int:
    """The number of rows of a page: what was asked for if that is a number over 0, at most ``most``."""
    try:
        n = float(asked)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return usual
    return usual if not 0 < n < float("inf") else min(int(n) or usual, most)


def view(name: str, tables: dict[str, DataFrame], limit: object = None) -> DataFrame | None:
    """The rows of a named view in its order, None where its table isn't there."""
    v = VIEWS[name]
    if v.table not in tables:
        return None
    rows = tables[v.table]
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in v.order]
    rows = rows.orderBy(*order).limit(page_size(limit, v.usual))
    return rows.select(*v.columns) if v.columns else rows


def bundle(tables: dict[str, DataFrame], include: str = "", limit: object = None) -> dict[str, DataFrame]:
    """Several views at once: those named in a comma list, all where it is empty; views without a table are left out."""
    asked = {x.strip() for x in include.split(",")} - {""} or set(VIEWS)
    found = {name: view(name, tables, limit) for name in VIEWS if name in asked}
    return {name: rows for name, rows in found.items() if rows is not None}


def envelope(kind: str, rows: DataFrame, as_of: Column) -> DataFrame:
    """One row: version, type, time, count, and the rows as a JSON list. Only for pages, whose size is bounded."""
    data = F.collect_list(F.to_json(F.struct(*rows.columns)))
    return rows.agg(F.count("*").alias("count"), F.concat(F.lit("["), F.array_join(data, ","), F.lit("]")).alias("data")).select(
        F.lit(1).alias("version"), F.lit(kind).alias("type"), as_of.alias("generated_at"), "count", "data")


def history(days: DataFrame, last: int = 30) -> DataFrame:
    """The newest days (day, category, severity rows) with their counts and histograms."""
    return rollups.day_history(days, "day", F.col("category"), F.col("severity")).orderBy(F.desc("day")).limit(last)


def health(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row for each table that is there, with its number of rows."""
    counts: list[Callable[[], DataFrame]] = [lambda n=n, t=t: t.agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n,
        t in sorted(tables.items())]
    out = spark.createDataFrame([], "table string, n long")
    for one in counts:
        out = out.unionByName(one())
    return out


def status(updated: Column, as_of: Column, hours: float) -> Column:
    """How fresh a source is: missing, fresh or stale."""
    return F.when(updated.isNull(), "missing").when(updated >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"),
        "fresh").otherwise("stale")


def source_status(configured: bool, refreshing: bool, failed: bool, n_rows: int) -> str:
    """The state of a source: not configured, refreshing, ok, degraded (failed, but with rows) or error."""
    if not configured:
        return "not_configured"
    if refreshing:
        return "refreshing"
    return "ok" if not failed else "degraded" if n_rows else "error"


#: Hosts from which pictures are passed on, and the most bytes of one.
PICTURE_HOSTS = ("cdn.jetphotos.com", "t.plnspttrs.net", "photos.marinetraffic.com", "www.marinetraffic.com")
PICTURE_BYTES = 500 * 1024


def pictures(rows: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """Pictures of allowed hosts over https, within the size, as base64 text."""
    name = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    good = (F.try_parse_url(F.col(url), F.lit("PROTOCOL"))
        == "https") & name.isin(*PICTURE_HOSTS) & (F.octet_length(content) <= PICTURE_BYTES)
    return rows.where(F.coalesce(good, F.lit(False))).select(url, F.base64(content).alias("data"))


def launch_guard(running: bool, new_examples: int, hours_since_last: float | None, least: int = 200, cooldown_hours: float = 2.0) -> bool:
    """Whether a training job may be started: none running, enough new examples, and the last one long enough ago."""
    return not running and new_examples >= least and (hours_since_last is None or hours_since_last >= cooldown_hours)
