"""A day's map by plain rules: conflict codes, one row per address, keyword scores, the first fitting category, the best 800."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import tone_color
from ..functions.text import accents, has_term, host, title_of_url
from .labels import country_place
from .scoring import _computed

# Codes, bounds, words and their points, categories, hosts that are never of interest.
MATERIAL, VERBAL = ("13", "14", "15", "16", "17", "18", "19", "20"), ("13", "15", "17", "18", "19", "20")
MOST_MATERIAL, MOST_VERBAL, PLACED = -1.0, -5.0, ("3", "4", "5")
OPERATIONAL = (
    "military", "army", "navy", "air force", "missile", "strike", "attack", "drone", "artillery", "troops", "troop", "soldier", "forces",
        "defense", "defence", "conflict", "war",
    "battle", "combat", "insurgent", "terror", "terrorist", "explosion", "blast", "shelling", "bombing", "raid", "airstrike", "militia",
        "border clash", "hostage", "coup", "sanction",
    "evacuation", "protest", "riot", "demonstration", "unrest", "clashes", "crisis", "incident", "security", "police", "emergency",
        "martial law", "ceasefire", "offensive",
    "detained", "arrested", "killed", "wounded", "rebels", "insurgency", "gunfire", "fighting", "rocket", "air raid", "siege",
        "mobilization", "paramilitary",
)
POINTS = {
    "missile": 25, "war": 25, "airstrike": 24, "bombing": 24, "terrorist": 24, "attack": 22, "military": 20, "strike": 20, "drone": 20,
        "hostage": 20, "protest": 18, "riot": 18,
    "explosion": 18, "troops": 16, "crisis": 15, "incident": 12,
}
OTHER_POINTS, TONE_POINTS = 20, 10
NOISE = (
    "photo review", "american dream", "expo", "conexpo", "fashion", "celebrity", "movie", "film", "music", "festival", "sports", "match",
        "football", "soccer", "nba", "nfl",
    "baseball", "cricket", "concert", "award", "red carpet", "tv show", "podcast", "entertainment", "gallery", "photos", "photo gallery",
        "weekend", "lifestyle", "recipe",
    "restaurant", "horoscope", "tourism", "travel", "stock", "market", "earnings", "real estate", "deal", "shopping", "review", "ipo",
        "startup", "funding round",
    "quarterly results", "revenue", "pleads guilty", "pleads not guilty", "plead guilty", "not guilty plea", "found guilty",
        "found not guilty", "convicted of", "acquitted",
    "sentenced to", "sentencing hearing", "faces sentencing", "court hears", "court rules", "court finds", "court orders", "court rejects",
        "court dismisses", "court blocks",
    "court upholds", "court denies", "fails in court", "fails in nsw", "nsw court", "nsw supreme", "suppression order",
        "suppress identities", "non-publication", "inquest",
    "coroner", "coroners court", "inquest hears", "bail hearing", "bail granted", "bail denied", "remanded in custody", "arraigned",
        "indicted", "indictment", "grand jury",
    "lawsuit filed", "civil lawsuit", "class action", "years in prison", "life in prison", "prison sentence", "appeal court",
        "appeals court", "court of appeal", "murder trial",
    "terrorism trial", "war crimes trial", "on trial for", "stands trial", "goes on trial", "testimony", "takes the stand",
        "witness stand", "prosecutor says", "defense attorney",
    "defence attorney", "anniversary", "years ago", "one year after", "two years after", "looks back", "in retrospect", "remembering",
        "commemorat", "memorial service",
    "tribute to", "in memory of", "explainer", "fact check", "what to know", "everything you need", "how to protect", "tips for",
        "guide to", "what is", "opinion:", "op-ed",
    "column:", "letter to the editor", "health tips", "weight loss", "diet", "fitness", "wellness", "mental health awareness", "self care",
)
NOISE_HOSTS = (
    "espn.com", "bleacherreport.com", "nba.com", "nfl.com", "mlb.com", "tmz.com", "people.com", "eonline.com", "variety.com",
        "hollywoodreporter.com", "buzzfeed.com",
    "buzzfeednews.com", "dailymail.co.uk", "foodnetwork.com", "allrecipes.com", "tripadvisor.com", "techcrunch.com", "engadget.com",
        "theverge.com", "wired.com", "marketwatch.com",
    "investopedia.com", "fool.com",
)
CATEGORIES = (
    ("terrorism", "#ff0044", ("terrorist", "terrorism", "suicide bomb", "isis", "al-qaeda", "al qaeda", "jihad", "ied", "car bomb",
            "beheading", "kidnap", "hostage", "extremist")),
    ("military", "#ff6600", (
        "airstrike", "air strike", "missile", "artillery", "shelling", "bombardment", "navy", "air force", "fighter jet", "warplane",
            "tank", "drone strike", "mobilization",
        "paramilitary", "armed forces", "military operation", "offensive", "siege", "ceasefire", "air raid", "rocket attack",
            "troops deployed",
    )),
    ("conflict", "#ffaa00", (
        "war", "battle", "combat", "fighting", "clashes", "gunfire", "killed", "wounded", "rebels", "insurgent", "insurgency",
            "border clash", "shootout", "armed clash", "militia",
        "raid", "bombing", "blast", "explosion",
    )),
    ("protest", "#ffee00", (
        "protest", "riot", "demonstration", "unrest", "march", "rally", "uprising", "civil unrest", "dissent", "blockade", "occupy",
            "strike action", "walkout", "coup",
    )),
    ("crisis", "#cc44ff", (
        "crisis", "emergency", "martial law", "sanction", "evacuation", "displaced", "refugee", "humanitarian", "famine", "epidemic",
            "disaster", "state of emergency", "crackdown",
        "detained", "arrested",
    )),
)
OTHER, OTHER_COLOR, MOST, SPREAD = "incident", "#4a6a7a", 800, 0.5


def plain_text(text: Column) -> Column:
    """Lower case without marks; what isn't an ASCII letter, digit or one of :/._- is a blank, and blanks are squeezed."""
    marked, plain = accents()
    out = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain), r"[\x{0300}-\x{036f}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s:/._-]", " "), r"\s+", " "))


def is_conflict(quad: Column, root: Column, goldstein: Column, geo_type: Column) -> Column:
    """Material conflict from -1 down or spoken conflict from -5 down, of the codes that count, at a city or region."""
    material = (quad == "4") & root.isin(*MATERIAL) & (goldstein <= MOST_MATERIAL)
    verbal = (quad == "3") & root.isin(*VERBAL) & (goldstein <= MOST_VERBAL)
    return F.coalesce((material | verbal) & ~F.isnan(goldstein) & geo_type.isin(*PLACED), F.lit(False))


def keyword_score(tone: Column, text: Column) -> Column:
    """Ten points for each point of tone, and the points of every word that the plain text holds."""
    words = reduce(lambda a, b: a + b, (F.when(text.contains(w), POINTS.get(w, OTHER_POINTS)).otherwise(0) for w in OPERATIONAL))
    return F.abs(F.coalesce(F.nanvl(tone, F.lit(0.0)), F.lit(0.0))) * TONE_POINTS + words


def first_category(text: Column) -> tuple[Column, Column]:
    """Name and colour of the first category of which the plain text holds a word."""
    name, color = F.lit(OTHER), F.lit(OTHER_COLOR)
    for key, own, words in reversed(CATEGORIES):
        holds = has_term(text, list(words))
        name, color = F.when(holds, key).otherwise(name), F.when(holds, own).otherwise(color)
    return name, color


def placed(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows with a place, or else with that of the country that they name; others go.

    ``countries``: name, code, ord, lat, lon, few rows. Only the different names of unplaced rows are looked up in it.
    """
    c = F.col
    missing = c("lat").isNull() | F.isnan("lat") | c("lon").isNull() | F.isnan("lon")
    marked = rows.withColumn("name_", F.when(missing, F.coalesce(F.nullif("location", F.lit("")), "country")))
    names = marked.where("name_ is not null").select(c("name_").alias("key"), c("name_").alias("location")).distinct()
    found = country_place(names, countries.select("name", c("ord").cast("string").alias("code"), "ord")).join(
        countries.select(c("ord").cast("string").alias("code"), c("lat").alias("to_lat"), c("lon").alias("to_lon")), "code")
    out = marked.join(found.select(c("key").alias("name_"), "to_lat", "to_lon"), "name_", "left").where(~missing | c("to_lat").isNotNull())
    return out.withColumns({"lat": F.when(missing, c("to_lat")).otherwise(c("lat")),
            "lon": F.when(missing, c("to_lon")).otherwise(c("lon"))}).drop("name_", "to_lat", "to_lon")


def best_of_address(rows: DataFrame) -> DataFrame:
    """Of each address the row with the highest score, of equals the latest date, then the first."""
    order = [F.desc("score"), F.desc(F.coalesce("date", F.lit(""))), F.col("ord")]
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("rank_ = 1").drop("rank_")


def day_map(events: DataFrame, countries: DataFrame, most: int = MOST) -> DataFrame:
    """The best events of a day, shifted by up to a quarter of a degree by a hash of their id.

    ``events``: id, ord, url, date, quad_class, root, goldstein, geo_type, location, country, lat, lon. Ranked by score, strength of tone
    and date, latest first.
    """
    c = F.col
    rows = events.where(is_conflict(c("quad_class"), c("root"), c("goldstein"), c("geo_type")) & (F.coalesce("url", F.lit("")) != ""))
    rows = placed(rows, countries).withColumns({"title": title_of_url(c("url")), "domain": host(c("url"))})
    rows = _computed(rows, {"text": plain_text(F.concat_ws(" ", "title", "url", "domain"))})
    rows = best_of_address(_computed(rows, {"score": keyword_score(c("goldstein"), c("text"))}))
    rows = rows.where(~c("domain").isin(*NOISE_HOSTS) & ~has_term(c("text"), list(NOISE)) & has_term(c("text"), list(OPERATIONAL)))
    rows = rows.withColumn("color", tone_color(c("goldstein")))
    top = rows.orderBy(F.desc("score"), F.desc(F.abs(F.coalesce("goldstein", F.lit(0.0)))), F.desc(F.coalesce("date", F.lit(""))),
        "ord").limit(most)
    drawn = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), c("id").cast("string"))), 1, 8), 16,
        10).cast("double") / F.lit(4294967296.0) - 0.5
    name, color = first_category(c("shown"))  # of the chosen ones only
    top = _computed(top, {"shown": plain_text(F.concat_ws(" ", "title", "url"))}).withColumns(
        {"category": name, "category_color": color}).drop("shown")
    return top.withColumns({"map_lat": c("lat") + drawn("a") * SPREAD, "map_lon": c("lon") + drawn("o") * SPREAD}).drop("text")
