"""The news cycle: domain and type of a headline, confidence, age, fuzzy duplicates and the map view."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from ..functions.numbers import clamp
from ..functions.text import word_set
from ..storage import Stage
from .selection import greedy_independent, keep_one

# Patterns of headlines, with what they mean, in the order in which they are tried.
STRATEGIC = "military|spy|reconnaissance|nro|classified|ussf|space force|dod|pentagon|space weapon|asat|anti.satellite|jamming|spoofing|electronic warfare|icbm|slbm|hypersonic|ballistic|nuclear|warhead|intelligence|surveillance|early warning|missile defense|missile tracking|space command|weaponiz"
SPATIAL_NOISE = (
    r"artemis\s*(?:i{1,3}|[1-4]|program|mission|crew|moon|lunar)|moon\s*(?:mission|landing|base|program|exploration|return)|mars\s*(?:mission|rover|helicopter|sample|colony|base|exploration)"
    r"|james webb|hubble|jwst|voyager|curiosity\s*rover|perseverance\s*rover|europa\s*clipper|dragonfly\s*mission|space\s*tour|space\s*tourism|space\s*tourist|civilian\s*astronaut|private\s*astronaut"
    r"|space\s*hotel|axiom\s*mission|inspiration4|polaris\s*dawn|blue\s*origin.*(?:tourist|crew|passenger)|virgin\s*galactic|asteroid\s*(?:sample|mining|redirect|defense|mission)|comet|exoplanet|telescope"
    r"|deep\s*space\s*network|planetary\s*defense|solar\s*probe|solar\s*orbiter|how\s*to\s*(?:see|watch|view)|viewing\s*guide|visible\s*(?:from|in)|sonic\s*boom|livestream|live\s*stream|live\s*coverage"
    r"|launch\s*(?:photo|video|watch|viewing)|(?:photo|video).*launch|watching.*launch|launch.*watch|spacex.*(?:record|milestone|anniversary|100th)"
)
DOMAINS = (
    ("missile", "missile|ballistic|hypersonic|icbm|slbm|warhead", ""),
    ("military", "hezbollah|hamas|idf|israel.*rocket|rocket.*platform.*target|strikes.*rocket", ""),
    ("spatial",
        "satellite|space launch|orbit|space force|spaceforce|spacex|starlink|falcon 9|atlas v|vulcan|nasa.*launch|blue origin|vandenberg|cape canaveral|wallops|minotaur|delta iv|soyuz|long march|ariane|vega.*rocket|electron.*rocket|rocket lab|ula |iss |international space station|cosmodrome|baikonur|jiuquan|xichang|wenchang|space daily|spaceflight|spacety|xona space",
        ""),
    ("spatial", "rocket launch|rocket.*liftoff|launch.*rocket",
        "strike|attack|target|military|bomb|shell|hezbollah|hamas|idf|israel|intercept"),
    ("naval", "naval|warship|carrier|submarine|fleet|destroyer|frigate|navy", ""),
    ("aviation", "fighter jet|airstrike|air force|drone strike|military aircraft|bomber|f-35|f-16|su-", ""),
)
TYPES = {
    "spatial": (("satellite launch|rocket launch|space launch|orbital launch", "satellite_launch"),
        ("spy|reconnaissance|nro|classified satellite", "spy_satellite"), ("debris|collision|space.*incident", "space_incident"),
        ("reentry|re-entry", "reentry_risk"), ("asat|anti.satellite|jamming|spoofing|space.*weapon", "space_warfare")),
    "missile": (("test", "missile_test"), ("ballistic", "ballistic_missile"), ("hypersonic", "hypersonic_test"),
        ("intercept", "missile_defense")),
    "naval": (("exercise", "naval_exercise"), ("deploy", "fleet_deployment"), ("carrier", "carrier_ops"),
        ("submarine", "submarine_activity"), ("patrol", "naval_patrol")),
    "aviation": (("airstrike|strike", "airstrike"), ("drone", "drone_strike"), ("intercept", "air_intercept"),
        ("exercise", "air_exercise")),
    "military": (("escalat", "escalation"), ("deploy", "troop_deployment"), ("clash", "border_clash"), ("offensive", "offensive"),
        ("ceasefire", "ceasefire"), ("sanction", "sanctions")),
}
#: (domain or "" for all, points, pattern, pattern that must not be there).
POINTS = (
    ("", 12, "test|strike|attack|deploy|exercise|fire|intercept|shoot|bomb|detonate|explosion|incident|breach|intrusion", ""),
    ("spatial", -50, SPATIAL_NOISE, STRATEGIC),
    ("spatial", 25,
        "rocket launch|satellite launch|space launch|orbital launch|missile launch|ballistic.*launch|launch.*satellite|launch.*rocket|launch.*orbit|liftoff.*rocket|rocket.*liftoff",
        ""),
    ("spatial", 20, STRATEGIC, ""),
    ("spatial", -40, "launch",
        "rocket|satellite|space|orbital|orbit|missile|capsule|payload|vehicle|booster|spacecraft|probe|liftoff|pad|silo|icbm|slbm|sounding"),
    ("spatial", -45,
        "how to (see|watch|view)|viewing guide|liftoff (time|tonight)|visible (from|in)|sonic boom|ticket|livestream|live stream|live coverage|photo.*launch|launch.*photo|watching.*launch|launch.*watch",
        ""),
    ("spatial", -25, "spacex|falcon 9|starlink", STRATEGIC),
    ("spatial", -40, "artemis|moon mission|lunar.*mission|mars.*mission", STRATEGIC),
    ("aviation", 20,
        "military|airstrike|air strike|bomber|fighter|f-35|f-16|su-|mig|drone strike|shootdown|intercept|scramble|warplane|combat|air force|close air support",
        ""),
    ("aviation", -50,
        "airline|passenger|commercial flight|airport|flight delay|ticket|booking|baggage|travel|tourism|runway|gate|departure|arrival|cargo plane|freighter",
        ""),
    ("naval", 20,
        "military|warship|navy|naval|destroyer|frigate|submarine|carrier|exercise|patrol|drill|blockade|incident|collision|intrusion|contested",
        ""),
    ("naval", -50,
        "cruise ship|container ship|cargo ship|merchant|ferry|fishing|coast guard rescue|grounded|stuck|accident|pollution|piracy.*cargo|shipping lane.*trade",
        ""),
    ("missile", 15, "launch|test|fire|intercept|detonate|explode|hit|struck|shoot down", ""),
    ("missile", -30, "launch", "missile|rocket|ballistic|hypersonic|icbm|slbm|warhead|projectile|munition|weapon"),
    ("military", 15,
        "offensive|assault|battle|war|conflict|casualt|killed|soldier|troops|frontline|ceasefire|escalat|invasion|occupation|siege", ""),
    ("military", -25, "summit|diplomat|sanction|trade war|tariff|negotiat", "military|troops|army|force|weapon"),
    ("", -20, "opinion|editorial|could|might|may consider|if.*war|hypothetical|scenario|what if", ""),
    ("", -30, r"historical|anniversary|years ago|world war ii|cold war era|in \d{4}|commemorat|memorial", ""),
    ("", -60, "sport|football|soccer|basketball|cricket|olympic|medal|tourism|hotel|restaurant|recipe|fashion|entertainment", ""),
    ("", -40, "stock|shares|earnings|revenue|profit|ipo|startup|investment|market cap|quarterly|fiscal|dividend",
        "sanction|embargo|military|weapon|defense"),
    ("", -35, "school board|curriculum|university|vaccine|covid|pandemic|hospital|patient|medical", "attack|military|weapon|strike|bomb"),
    ("", -25, "summit|state visit|trade agreement|trade deal|diplomatic visit|bilateral talks",
        "military|weapon|nuclear|sanction|crisis|war|conflict"),
)
BASE, SAME_DOMAIN, PLACED, SHORT_TITLE, SHORT_WORDS = 55, 10, 15, 5, 15
LEAST_CONFIDENCE = {"spatial": 62, "aviation": 60, "naval": 60, "missile": 55, "military": 50}
MAP_CONFIDENCE, OLDEST_HOURS = 30, 48
DEDUP_HOURS, NEAR_HOURS, NEAR_KM = 72, 6, 100.0
ALIKE, ALIKE_SAME_SOURCE, ALIKE_NEAR = 0.55, 0.35, 0.40
GRAY, GRAY_HOURS = (0.25, 0.55), 24


def _says(text: Column, pattern: str, but: str = "") -> Column:
    return text.rlike(pattern) & ~text.rlike(but) if but else text.rlike(pattern)


def spatial_noise(title: Column) -> Column:
    """Civil and public space news without anything strategic."""
    return _says(F.lower(title), SPATIAL_NOISE, STRATEGIC)


def domain_of(title: Column) -> Column:
    text, out = F.lower(title), F.lit("military")
    for name, pattern, but in reversed(DOMAINS):
        out = F.when(_says(text, pattern, but), name).otherwise(out)
    return out


def type_of(title: Column, domain: Column) -> Column:
    """The first type of the domain that the headline names, else the domain itself."""
    text, out = F.lower(title), domain
    for name, kinds in TYPES.items():
        own = domain
        for pattern, kind in reversed(kinds):
            own = F.when(text.rlike(pattern), kind).otherwise(own)
        out = F.when(domain == name, own).otherwise(out)
    return out


def confidence(title: Column, domain: Column, feed_domain: Column, placed: Column) -> Column:
    """Points of a headline, from 10 to 95."""
    text = F.lower(title)
    parts = [
        F.lit(BASE), F.when(domain == feed_domain, SAME_DOMAIN).otherwise(0), F.when(placed, PLACED).otherwise(0),
        F.when(F.size(F.split(text, r"\s+")) <= SHORT_WORDS, SHORT_TITLE).otherwise(0),
    ]
    for name, points, pattern, but in POINTS:
        holds = _says(text, pattern, but)
        parts.append(F.when(holds & (domain == name) if name else holds, points).otherwise(0))
    return clamp(reduce(lambda a, b: a + b, parts), 10, 95)


def least_confidence(domain: Column) -> Column:
    out = F.lit(LEAST_CONFIDENCE["military"])
    for name, least in LEAST_CONFIDENCE.items():
        out = F.when(domain == name, least).otherwise(out)
    return out


def recent_enough(ts: Column, as_of: Column, hours: int = OLDEST_HOURS) -> Column:
    """No date, or one that is at most so old."""
    return ts.isNull() | (ts >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def short_key(title: Column) -> Column:
    """ASCII word characters of a title, 80 at most."""
    return F.substring(F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_]", ""), 1, 80)


def classified(items: DataFrame) -> DataFrame:
    """Items (title, feed_domain, lat, lon) with domain, type, confidence and whether that is enough."""
    c = F.col
    out = items.withColumn("domain", domain_of(c("title")))
    out = out.withColumns({"type": type_of(c("title"), c("domain")),
            "confidence": confidence(c("title"), c("domain"), c("feed_domain"), c("lat").isNotNull())})
    return out.withColumn("enough", c("confidence") >= least_confidence(c("domain")))


#: Items of a stretch of time that a task holds against as many others, and how many of them at once.
TILE, AT_ONCE = 4000, 250


def _alike(items: DataFrame, least: float, hours: int, order: str, told: Callable) -> DataFrame:
    """(a, b, similarity, older): pairs of items at most ``hours`` apart and at least so alike of which ``told`` is true, a first by ``order``.

    ``told(similarity, apart, same_source, km)`` takes numpy arrays. ``older``: the one that goes if both tell the same, of one time
    the later in order. Items are dealt to tiles of their stretch of time, and each pair of tiles of a stretch or of two neighbours is one
    group, which counts common words by a product of matrices for frequent words and by the rare words' rows. So only items are
    shuffled, however many pairs there are.
    """
    seconds = F.unix_seconds("ts")
    rows = items.where(F.col("ts").isNotNull() & F.col(order).isNotNull()).select("id", F.col(order).alias("ord"), seconds.alias("seconds"),
        F.unix_micros("ts").alias("at"), "source", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        word_set(F.col("title")).alias("words"), F.floor(seconds / (3600 * hours)).cast("long").alias("s"))
    fullest = rows.groupBy("s").count().agg(F.max("count")).first()[0]
    tiles = -(-(fullest or 1) // TILE)
    own, n = F.pmod(F.xxhash64("id", "ord"), F.lit(tiles)).cast("int"), F.sequence(F.lit(0), F.lit(tiles - 1))
    cell = lambda s, next_, i, j, second: F.struct(s.alias("s"), F.lit(next_).alias("next"), i.alias("i"), j.alias("j"),
        second.alias("second"))
    cells = F.concat(
        F.transform(n, lambda x: cell(F.col("s"), 0, F.least(F.col("own"), x), F.greatest(F.col("own"), x), F.col("own") > x)),
        F.transform(n, lambda x: cell(F.col("s"), 1, F.col("own"), x, F.lit(False))),
        F.transform(n, lambda x: cell(F.col("s") - 1, 1, x, F.col("own"), F.lit(True))))
    dealt = rows.withColumn("own", own).select("id", "ord", "seconds", "at", "source", "lat", "lon", "words", F.inline(cells))
    radius, at_once = EARTH_KM, AT_ONCE

    def pairs(cell: pa.Table) -> pa.Table:
        ids, second = cell["id"].combine_chunks(), cell["second"].to_numpy()
        kind = ids.type
        one = not cell["next"][0].as_py() and cell["i"][0].as_py() == cell["j"][0].as_py()
        place = np.unique(cell["ord"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        seconds, at, lat, lon = (cell[x].to_numpy() for x in ("seconds", "at", "lat", "lon"))
        names = cell["source"].combine_chunks().dictionary_encode()
        source = names.indices.fill_null(-1).to_numpy()
        words = cell["words"].combine_chunks()
        size = words.value_lengths().fill_null(0).to_numpy()
        code = words.flatten().dictionary_encode().indices.to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        left = np.arange(len(size)) if one else np.flatnonzero(~second)
        right = left if one else np.flatnonzero(second)
        empty = pa.table({"a": pa.array([], kind), "b": pa.array([], kind), "similarity": pa.array([], pa.float64()), "older": pa.array([], kind)})
        if not len(left) or not len(right) or not len(code):
            return empty
        sides = []
        for side in (left, right):
            here = np.full(len(size), -1)
            here[side] = np.arange(len(side))
            sides.append((here[row][here[row] >= 0], code[here[row] >= 0]))
        (a_row, a_code), (b_row, b_code) = sides
        n_codes = int(code.max()) + 1
        n_a, n_b = np.bincount(a_code, minlength=n_codes), np.bincount(b_code, minlength=n_codes)
        often = n_a * n_b * 300 > len(left) * len(right)
        column = np.cumsum(often) - 1
        dense = []
        for side, r, w in ((left, a_row, a_code), (right, b_row, b_code)):
            matrix = np.zeros((len(side), int(often.sum())), np.float32)
            matrix[r[often[w]], column[w[often[w]]]] = 1
            dense.append(matrix)
        rare = ~often & (n_a > 0) & (n_b > 0)
        a_rare, b_rare = rare[a_code], rare[b_code]
        a_row, a_code = a_row[a_rare], a_code[a_rare]
        by = np.argsort(b_code[b_rare], kind="stable")
        b_row, b_start = b_row[b_rare][by], np.searchsorted(b_code[b_rare][by], np.arange(n_codes + 1))
        out = [empty]
        for start in range(0, len(left), at_once):
            own = left[start : start + at_once]
            common = dense[0][start : start + at_once] @ dense[1].T
            lo, hi = np.searchsorted(a_row, (start, start + len(own)))
            if hi > lo:
                w, r = a_code[lo:hi], a_row[lo:hi] - start
                n = b_start[w + 1] - b_start[w]
                to = b_row[np.repeat(b_start[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                common += np.bincount(np.repeat(r, n) * len(right) + to, minlength=common.size).reshape(common.shape)
            longer = np.maximum(size[own][:, None], size[right][None, :])
            x, y = np.nonzero((common >= longer * least - 1e-3) & (common > 0))
            similarity, x, y = np.rint(common[x, y]).astype(np.float64) / longer[x, y], own[x], right[y]
            apart = np.abs(seconds[x] - seconds[y])
            keep = (apart <= 3600 * hours) & ((place[x] < place[y]) if one else (place[x] != place[y]))
            x, y, similarity, apart = x[keep], y[keep], similarity[keep], apart[keep]
            p = np.sin(np.radians(lat[y] - lat[x]) / 2) ** 2
            p = p + np.cos(np.radians(lat[x])) * np.cos(np.radians(lat[y])) * np.sin(np.radians(lon[y] - lon[x]) / 2) ** 2
            km = 2 * radius * np.arctan2(np.sqrt(p), np.sqrt(np.maximum(0.0, 1 - p)))
            keep = told(similarity, apart, (source[x] == source[y]) & (source[x] >= 0), km)
            x, y, similarity = x[keep], y[keep], similarity[keep]
            x, y = np.where(place[x] < place[y], x, y), np.where(place[x] < place[y], y, x)
            out.append(pa.table({"a": ids.take(pa.array(x)), "b": ids.take(pa.array(y)), "similarity": similarity,
                "older": ids.take(pa.array(np.where(at[x] >= at[y], y, x)))}).cast(empty.schema))
        return pa.concat_tables(out)

    kinds = rows.schema["id"].dataType.simpleString()
    return dealt.groupBy("s", "next", "i", "j").applyInArrow(pairs, f"a {kinds}, b {kinds}, similarity double, older {kinds}")


def duplicates(items: DataFrame, order: str = "ord") -> DataFrame:
    """(a, b): pairs of items, a first by ``order``, that tell the same by words, time, source and place.

    ``items``: id, title, ts, source, lat, lon and the order.
    """
    alike, alike_same_source, alike_near, soon, near_km = ALIKE, ALIKE_SAME_SOURCE, ALIKE_NEAR, 3600 * NEAR_HOURS, NEAR_KM

    def told(similarity, apart, same_source, km):
        return (similarity > alike) | (same_source & (apart < soon) & (similarity > alike_same_source)) | ((km < near_km)
            & (similarity > alike_near))

    return _alike(items, ALIKE_SAME_SOURCE, DEDUP_HOURS, order, told).select("a", "b")


def gray_pairs(items: DataFrame, order: str = "ord") -> DataFrame:
    """Pairs that may tell the same: similarity in the gray band, within a day; with the older of both, for ``without_gray``."""
    least, most = GRAY
    return _alike(items, least, GRAY_HOURS, order, lambda similarity, apart, same_source, km: (similarity >= least) & (similarity < most))


def unique_items(items: DataFrame, order: str = "ord") -> DataFrame:
    """One item of each short title key, then none that repeats a kept one."""
    once = keep_one(items.withColumn("key_", short_key(F.col("title"))), ["key_"], F.col(order)).drop("key_")
    return greedy_independent(once, duplicates(once, order), "id", Stage(items.sparkSession, "news"))


def without_gray(items: DataFrame, verdicts: DataFrame, order: str = "ord") -> DataFrame:
    """The items without the older one of each pair (a, b) that was judged the same; of one time, or without any, the one later in order goes.

    Every verdict counts by itself: an item that one pair takes away still takes away others by its own pairs.
    """
    if "older" in verdicts.columns:  # as ``gray_pairs`` says
        return items.join(verdicts.where("same").select(F.col("older").alias("id")).distinct(), "id", "left_anti")
    when = F.coalesce(F.unix_micros("ts"), F.lit(0))
    side = lambda n: items.select(F.col("id").alias(n),
        F.struct(F.col(order).alias("ord"), when.alias("at"), F.col("id").alias("id")).alias(f"{n}_"))
    pairs = verdicts.where("same").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    first, second = F.least("a_", "b_"), F.greatest("a_", "b_")  # by their place in order
    gone = pairs.select(F.when(first["at"] >= second["at"], second["id"]).otherwise(first["id"]).alias("id")).distinct()
    return items.join(gone, "id", "left_anti")


#: Colours and labels of the map.
MAP_STYLE = {"spatial": ("#a855f7", "SPATIAL"), "missile": ("#ef4444", "MISSILE"), "naval": ("#3b82f6", "NAVAL"),
    "aviation": ("#f59e0b", "AVIATION"), "military": ("#dc2626", "MILITARY")}


def for_map(events: DataFrame) -> DataFrame:
    """Placed events that are sure enough, with colour and label of their domain."""
    color, label = F.lit("#888"), F.lit("NEWS")
    for name, (own_color, own_label) in MAP_STYLE.items():
        color, label = F.when(F.col("domain") == name, own_color).otherwise(color), F.when(F.col("domain") == name,
            own_label).otherwise(label)
    placed = events.where((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0)
        & (F.col("confidence") >= MAP_CONFIDENCE))
    return placed.withColumns({"color": color, "label": label})


#: Domains of the views; the view of everything else leaves out what has one of its own.
VIEWS = {"air": ("aviation",), "sea": ("naval",), "space": ("spatial",)}


def in_view(events: DataFrame, view: str) -> DataFrame:
    """Events of one view of the map: air, sea, space, ``osint`` for all without a view of their own, or another name for all."""
    if view == "osint":
        return events.where(~F.coalesce(F.col("domain").isin(*(d for own in VIEWS.values() for d in own)), F.lit(False)))
    return events.where(F.col("domain").isin(*VIEWS[view])) if view in VIEWS else events


def merged_cache(new: DataFrame, existing: DataFrame, as_of: Column, most: int = 500) -> DataFrame:
    """New items first, then those of the last 72 hours, in their orders; at most ``most``: a report's cap."""
    fresh = existing.where(F.col("ts") > as_of - F.expr(f"INTERVAL {DEDUP_HOURS} HOURS"))
    both = new.withColumn("old_", F.lit(0)).unionByName(fresh.withColumn("old_", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("old_", "ord", "id").limit(most).drop("old_")
