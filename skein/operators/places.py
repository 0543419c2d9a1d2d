"""The place that a headline tells of: candidates by patterns, all shrinking prefixes of them, and equality joins with a gazetteer.

A ladder of five stages decides, the first that finds something:

1. a zone (sea, strait, base, contested region) named anywhere, the longest first; buildings that stand for an actor don't count;
2. a name after a word of place or an act that hits a target ("in Kharkiv", "strikes Beirut"), cut from the right until the gazetteer knows it;
3. a name before an act or a force ("China launches", "Israel's navy"), only as a zone or a country;
4. a country or its adjective anywhere, the longest first;
5. the first name of stage 2 that may be asked of a geocoder, without coordinates.

A title is never joined itself: what is joined are its few candidates and its runs of words, with the key of its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no places, buildings that stand for actors, suffixes of districts.
STOPWORDS = (
    "the", "this", "that", "new", "first", "two", "three", "more", "top", "major",
    "says", "said", "reports", "after", "before", "amid", "during", "about",
    "military", "nuclear", "missile", "satellite", "naval", "army", "navy",
    "air", "force", "defense", "attack", "strike", "war", "conflict",
    "breaking", "update", "analysis", "opinion", "exclusive", "report",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
    "least", "pictures", "photos", "photo", "video", "videos", "watch", "live",
    "alert", "edge", "terror", "terrorism", "crisis", "peace", "talks", "deal",
    "agreement", "summit", "second", "third", "fourth", "fifth", "final", "next",
    "last", "day", "days", "week", "weeks", "month", "year", "years", "state",
    "south", "north", "east", "west", "western", "eastern", "northern", "southern",
    "central", "strikes", "attacks", "forces", "troops", "weapons", "drone", "drones",
    "reuters", "bloomberg", "associated press", "afp", "cnn", "bbc", "fox",
    "nato", "un", "eu", "european union", "united nations",
    "spacex", "nasa", "boeing", "lockheed", "lockheed martin", "raytheon",
    "northrop", "northrop grumman", "airbus", "starlink", "roscosmos",
    "congress", "senate", "parliament", "president", "minister", "ministry",
    "biden", "trump", "putin", "zelensky", "zelenskyy", "netanyahu", "khamenei",
    "erdogan", "macron", "modi", "austin", "hegseth", "lavrov", "wang",
)
ACTOR_PLACES = ("pentagon", "white house", "kremlin")
SUFFIXES = r"\s+(?:region|oblast|province|district|county|prefecture|governorate|wilaya|state|raion|republic|area|zone|department|municipality)\s*$"

# The patterns of candidates, in a form that Java and RE2 both read.
NAME = r"([A-Z\x{C0}-\x{FF}][a-zA-Z\x{C0}-\x{FF}'\x{2019}-]+(?:\s+[A-Z\x{C0}-\x{FF}][a-zA-Z\x{C0}-\x{FF}'\x{2019}-]+){0,3})"
BESIDE = (
    r"(?:(?:the|a|an|its|his|her|their|southern|northern|eastern|western|central|occupied|rebel-held|war-torn|coastal|northwestern|northeastern"
    r"|southwestern|southeastern)\s+){0,2}"
)
LOCATIVE = (
    rf"\b(?:in|near|over|off|at|around|across|inside|outside|on|onto|into|toward|towards)\s+{BESIDE}{NAME}",
    r"\b(?:hits?|struck|strikes?|attack(?:s|ed)?|bomb(?:s|ed)?|shell(?:s|ed)?|pound(?:s|ed)?|target(?:s|ed)?|captures?|captured|seizes?|seized"
    rf"|liberates?|liberated|enters?|entered|invades?|invaded|reaches?|reached)\s+{BESIDE}{NAME}",
    rf"\b(?:en|au|aux|dans\s+le|dans\s+la|depuis|vers|sur)\s+{NAME}",
    rf"\b(?:en\s+el|en\s+la)\s+{NAME}",
)
SUBJECT = (
    rf"\b{NAME}\s+(?:launches?|tests?|fires?|deploys?|strikes?|attacks?|warns?|conducts?|holds?|begins?|masses?)",
    rf"\b{NAME}(?:'s|\x{{2019}}s)?\s+(?:military|navy|air\s+force|army|defen[cs]e|missile|satellite|forces|troops)",
    rf"\b(?:le|la|les)\s+{NAME}",
)
ZONE, COUNTRY, CITY = 0, 1, 2
LEAST_LENGTH, MOST_WORDS, SUBJECT_WORDS = 3, 4, 3
SAFE_LENGTH, SAFE_WORDS = 4, 3


def _is_stopword(lowered: Column) -> Column:
    return lowered.isin(*STOPWORDS)


def candidates(title: Column, patterns: tuple[str, ...]) -> Column:
    """All names that the patterns find, pattern by pattern, without possessive, stopwords and what is too short."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(p), F.lit(1)) for p in patterns)))
    named = F.transform(found, lambda m: F.trim(F.regexp_replace(m, r"(?i)['\x{2019}]s$", "")))
    return F.filter(named, lambda m: (F.length(m) >= LEAST_LENGTH) & ~_is_stopword(F.lower(m)))


def prefixes(candidate: Column, most: int) -> Column:
    """(n, name): the first n words of a candidate, from its ``most`` words on."""
    words = F.split(candidate, r"\s+")
    counts = F.sequence(F.least(F.size(words), F.lit(most)), F.lit(1))
    every = F.transform(counts, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("name")))
    return F.filter(every, lambda p: ~_is_stopword(F.lower(p["name"])))


def is_safe(candidate: Column) -> Column:
    """Whether a name that no table knows may be asked of a geocoder."""
    words = F.split(candidate, r"\s+")
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^a-zA-Z0-9_\x{E0}-\x{FF}'-]", "")
    return (F.length(candidate) >= SAFE_LENGTH) & (F.size(words) <= SAFE_WORDS) & ~F.exists(words, lambda w: _is_stopword(plain(w)))


def runs_of_words(title: Column, most: int) -> Column:
    """All stretches of up to ``most`` pieces of a lower-cased title that begin with a word; a piece is a word or one other character."""
    pieces = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9_]+|[^a-z0-9_]"), F.lit(0))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: F.get(pieces, i - 1).rlike("^[a-z0-9_]"))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)),
                    lambda n: F.array_join(F.slice(pieces, i, n), "")))))


def _known(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``asked`` (with name) beside the first entry of its lower-cased name, or else of that without a district's suffix."""
    whole = F.trim(F.lower("name"))
    both = asked.withColumns({"entry_": whole, "stage_": F.lit(0)})
    cut = F.trim(F.regexp_replace("entry_", SUFFIXES, ""))
    both = both.unionByName(both.where(cut != F.col("entry_")).withColumns({"entry_": cut, "stage_": F.lit(1)}))
    table = gazetteer.select(F.col("name").alias("entry_"), F.col("kind").alias("kind_"), F.col("ord").alias("ord_"),
        F.col("lat").alias("lat_"), F.col("lon").alias("lon_"))
    return both.join(table, "entry_")


def places_of_titles(titles: DataFrame, gazetteer: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key, place, stage, lat, lon): one row per title that tells of a place.

    ``titles``: key, title. ``gazetteer``: name (lower case), kind (0 zone, 1 country, 2 city), ord, lat, lon; of entries of one
    name the least kind and order counts. ``mentions``: said, canonical, ord: how countries are named in titles. Both tables
    are joined by equality, however large; the pieces of their longest names bound the runs of words.
    """
    rows = titles.select("key", "title")
    pieces = lambda c: F.size(F.regexp_extract_all(c, F.lit("[a-z0-9_]+|[^a-z0-9_]"), F.lit(0)))
    zones = gazetteer.where(F.col("kind") == ZONE).where(~F.col("name").isin(*ACTOR_PLACES))
    said = zones.select(F.col("name").alias("said"), F.col("name").alias("place"), "ord", F.lit(1).alias("stage"), "lat", "lon")
    countries = mentions.join(_best_of_name(gazetteer), F.col("canonical") == F.col("name")).select("said",
        F.col("canonical").alias("place"), mentions["ord"], F.lit(4).alias("stage"), "lat", "lon")
    said = said.unionByName(countries)
    longest = said.agg(F.max(pieces(F.col("said")))).first()[0] or 1
    runs = rows.select("key", F.explode(runs_of_words(F.col("title"), longest)).alias("said"))
    anywhere = runs.join(said, "said").select("key", "stage", (-F.length("said")).alias("a"), F.col("ord").cast("int").alias("b"),
        F.lit(0).alias("c"), F.lit(0).alias("d"), "place", "lat", "lon")

    def named(patterns: tuple[str, ...], most: int) -> DataFrame:
        each = rows.select("key", F.posexplode(candidates(F.col("title"), patterns)).alias("pos", "candidate"))
        return each.select("key", "pos", F.explode(prefixes(F.col("candidate"), most)).alias("p")).select("key", "pos", "p.n", "p.name")

    locative = _known(named(LOCATIVE, MOST_WORDS), gazetteer)
    shown = lambda df, stage, name: df.select("key", F.lit(stage).alias("stage"), F.col("pos").alias("a"), (-F.col("n")).alias("b"),
        F.col("stage_").alias("c"), (F.col("kind_") * 1_000_000 + F.col("ord_")).cast("int").alias("d"), name.alias("place"),
        F.col("lat_").alias("lat"), F.col("lon_").alias("lon"))  # noqa: E731, E501
    subject = _known(named(SUBJECT, SUBJECT_WORDS), gazetteer.where(F.col("kind") != CITY)).where("stage_ = 0")
    last = rows.select("key", F.posexplode(candidates(F.col("title"), LOCATIVE)).alias("a", "place")).where(is_safe(F.col("place")))
    zero, none = F.lit(0), F.lit(None).cast("double")
    last = last.select("key", F.lit(5).alias("stage"), "a", zero.alias("b"), zero.alias("c"), zero.alias("d"), "place", none.alias("lat"),
        none.alias("lon"))
    found = anywhere.unionByName(shown(locative, 2, F.col("name"))).unionByName(shown(subject, 3, F.lower("name"))).unionByName(last)
    best = found.groupBy("key").agg(F.min(F.struct("stage", "a", "b", "c", "d", "place", "lat", "lon")).alias("p"))
    return best.select("key", "p.place", "p.stage", "p.lat", "p.lon")


def _best_of_name(gazetteer: DataFrame) -> DataFrame:
    best = gazetteer.groupBy("name").agg(F.min(F.struct("kind", "ord", "lat", "lon")).alias("g"))
    return best.select("name", "g.lat", "g.lon")


LEAST_SURE, MOST_DOUBTS = 40, 100


def doubtful(items: DataFrame) -> DataFrame:
    """Items with ``where`` (own place or else the feed's hint), ``hint_only`` and ``doubt``: no own place, or too little confidence.

    ``items``: place (of the title, or null), hint, confidence.
    """
    own, hint = F.coalesce("place", F.lit("")), F.coalesce("hint", F.lit(""))
    where = F.when(own != "", own).otherwise(hint)
    hint_only = (own == "") & (hint != "")
    return items.withColumns({"where": where, "hint_only": hint_only,
            "doubt": (where == "") | hint_only | (F.coalesce("confidence", F.lit(0)) < LEAST_SURE)})


def answered(items: DataFrame, answers: DataFrame, most: int = MOST_DOUBTS) -> DataFrame:
    """Doubtful items after a provider's answers (id, location, confidence): its place where there was none of the title, the mean of both confidences.

    With more than ``most`` doubts nothing is asked, so nothing changes; items without an answer stay as they are.
    """
    asked = items.agg((F.count_if("doubt") <= most).alias("asked_"))
    back = answers.groupBy("id").agg(F.first(F.struct("location", "confidence")).alias("r_"))
    rows = items.join(F.broadcast(asked)).join(back, "id", "left")
    takes = F.col("asked_") & F.col("doubt")
    moved = takes & (F.coalesce("r_.location", F.lit("")) != "") & ((F.col("where") == "") | F.col("hint_only"))
    mean = F.floor((F.col("confidence") + F.col("r_.confidence")) / 2 + F.lit(0.5)).cast("long")
    rows = rows.withColumns({
        "where": F.when(moved, F.col("r_.location")).otherwise(F.col("where")), "hint_only": F.col("hint_only") & ~moved,
        "confidence": F.when(takes & F.col("r_.confidence").isNotNull(), mean).otherwise(F.col("confidence").cast("long")),
    })
    return rows.drop("r_", "asked_")


GEOCODED = "asked string, lat double, lon double"
_RAW = "array<struct<class string, type string, importance double, lat string, lon string>>"


def geocoded(names: DataFrame, ask: Callable, stage, cached: DataFrame | None = None, batch: int = 1, **how) -> DataFrame:
    """(asked, lat, lon) of the different names, to be given as ``cached`` the next time; null where no answer can be trusted.

    ``ask`` gets rows with ``id``, the name, and gives for each a dict of id and ``found``, the geocoder's JSON list. Names in ``cached`` are
    not asked again, those without a place neither; a name whose question failed isn't remembered.
    """
    from .providers import answers_of

    wanted = names.select(F.lower(F.trim("asked")).alias("id")).where("id <> ''").distinct()
    if cached is not None:
        wanted = wanted.join(cached.select(F.col("asked").alias("id")), "id", "left_anti")
    back = stage.keep(answers_of(wanted, ask, "id string, found string", batch, **how), "geocoded")
    each = back.select(F.col("id").alias("asked"), F.posexplode_outer(F.from_json("found", _RAW)).alias("ord", "r")).select("asked", "ord",
        "r.*")
    found = first_trusted(each)
    return found if cached is None else cached.select("asked", "lat", "lon").unionByName(found)


# What a geocoder's answer must be to be trusted.
SURE_CLASSES, CLASSES = ("military", "aeroway"), ("place", "boundary", "natural", "water")
LARGE_TYPES, LARGE_LEAST, OTHER_LEAST = ("country", "state", "region", "administrative", "city", "sea", "ocean"), 0.25, 0.35


def is_trusted(kind: Column, type_: Column, importance: Column, lat: Column, lon: Column) -> Column:
    """Whether a geocoder's answer is a place of note: bases always, large areas from a lower importance on. Unknown counts as none."""
    least = F.when(F.coalesce(type_, F.lit("")).isin(*LARGE_TYPES), LARGE_LEAST).otherwise(OTHER_LEAST)
    noted = F.coalesce(kind, F.lit("")).isin(*CLASSES) & (F.coalesce(importance, F.lit(0.0)) >= least)
    return (F.coalesce(lat, F.lit("")) != "") & (F.coalesce(lon, F.lit("")) != "") & (F.coalesce(kind, F.lit("")).isin(*SURE_CLASSES)
        | noted)


def first_trusted(answers: DataFrame) -> DataFrame:
    """(asked, lat, lon): the first trusted answer (asked, ord, class, type, importance, lat, lon) to each question; null where there is none."""
    good = is_trusted(F.col("class"), F.col("type"), F.col("importance"), F.col("lat"), F.col("lon"))
    pick = answers.groupBy("asked").agg(F.min(F.when(good,
                F.struct("ord", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")))).alias("p"))
    return pick.select("asked", "p.lat", "p.lon")
