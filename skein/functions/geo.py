"""Distances, angles, grids, regions and colour ladders as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def turn(before: Column, after: Column) -> Column:
    """Signed change of heading, by the remainder that keeps the sign."""
    return (after - before + 540) % 360 - 180


def grid(x: Column, size: int = 2) -> Column:
    """The nearest multiple of ``size``, halves upward, as an int."""
    return (half_up(x / size) * size).cast("int")


def cell_tenth(lat: Column, lon: Column) -> Column:
    """Key of a 0.1 degree cell."""
    return F.concat_ws(",", half_up(lat * 10).cast("string"), half_up(lon * 10).cast("string"))


def _box(lat: Column, lon: Column, south, north, west, east) -> Column:
    return (lat > south) & (lat < north) & (lon > west) & (lon < east)


def region_of_event(lat: Column, lon: Column, code: Column) -> Column:
    """The region of an event by ordered boxes, then by country. Boxes and codes."""
    europe = (
        F.when(code.isin("RU", "UA", "AM", "AZ", "GE", "KG", "KZ", "MD", "BY"), "russia_cis")
        .when((code == "FR") & _box(lat, lon, 41, 51.5, -5.5, 10), "france")
        .otherwise("europe")
    )
    return (
        F.when(_box(lat, lon, 34, 72, -25, 45), europe)
        .when(_box(lat, lon, 12, 43, 25, 65), "middleeast")
        .when(_box(lat, lon, -12, 55, 95, 150), "east_asia")
        .when(_box(lat, lon, 0, 40, 60, 95), "south_asia")
        .when(_box(lat, lon, -35, 38, -20, 55), "africa")
        .when(_box(lat, lon, -60, 15, -90, -30), "south_america")
        .when((lat > 15) & (lon > -170) & (lon < -50), "north_america")
        .when((lat < -10) & (lon > 110) & (lon < 180), "oceania")
        .when(code == "FR", "france")
        .when(code.isin("CN", "KP", "KR", "TW", "VN"), "east_asia")
        .when(code.isin("AF", "PK", "IN", "BD"), "south_asia")
        .when(code.isin("BR", "AR", "CL", "CO", "PE", "VE"), "south_america")
        .otherwise("other")
    )


def region_for_quota(lat: Column, lon: Column, code: Column, country: Column) -> Column:
    """The region that a selection quota counts. Boxes, codes, order."""
    name = F.lower(F.coalesce(country, F.lit("")))
    return (
        F.when((code == "FR") | name.contains("france"), "france")
        .when(code.isin("RS", "UP") | name.contains("russia") | name.contains("ukraine"), "russia_ukraine")
        .when(code.isin("CH", "TW", "KN", "KS", "JA", "VM") | _box(lat, lon, 15, 55, 95, 150), "east_asia")
        .when(
            code.isin("IN", "PK", "AF", "BG", "NP", "CE", "KZ", "KG", "TI", "TX", "UZ")
                | ((lat > 5) & (lat < 55) & (lon > 60) & (lon <= 95)),
            "south_central_asia",
        )
        .when(
            code.isin("IR", "IZ", "IS", "WE", "GZ", "JO", "LE", "SY", "SA", "YM", "AE", "QA", "KU", "BA", "MU", "TU")
                | _box(lat, lon, 12, 43, 25, 65),
            "middle_east",
        )
        .when(_box(lat, lon, -35, 38, -20, 55), "africa")
        .when(_box(lat, lon, -60, 15, -90, -30), "south_america")
        .when((lat >= 15) & (lat < 75) & (lon > -170) & (lon < -50), "north_america")
        .when(_box(lat, lon, -50, 5, 110, 180), "oceania")
        .when(_box(lat, lon, 34, 72, -25, 45), "europe")
        .otherwise("other")
    )


def region_on_map(lat: Column, lon: Column) -> Column:
    """The coarse region of the map filter. Boxes, order."""
    return (
        F.when(_box(lat, lon, 34, 72, -25, 45), "europe")
        .when(_box(lat, lon, 12, 43, 25, 65), "middleeast")
        .when(_box(lat, lon, -12, 55, 60, 150), "asia")
        .when(_box(lat, lon, -35, 38, -20, 55), "africa")
        .when((lon > -170) & (lon < -30), "americas")
        .otherwise("oceania")
    )


def severity(tone: Column) -> Column:
    return F.when(tone <= -7, "CRITICAL").when(tone <= -5, "SEVERE").when(tone <= -2, "HIGH").when(tone < 0, "MODERATE").otherwise("LOW")


def tone_color(tone: Column) -> Column:
    """Colours. Here -2 is still moderate, other than in ``severity``."""
    return (
        F.when(tone.isNull() | F.isnan(tone), "#4a6a7a")
        .when(tone <= -7, "#ff2244")
        .when(tone <= -5, "#ff5533")
        .when(tone < -2, "#ffaa00")
        .when(tone < 0, "#ffdd55")
        .otherwise("#00d4ff")
    )
