"""Text, URL and title functions as Columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def accents() -> tuple[str, str]:
    """Lower-case letters with marks and their plain letters: all up to U+024F and U+1EFF whose decomposition begins with a to z."""
    marked, plain = [], []
    for code in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and "a" <= base[0] <= "z":
            marked.append(c)
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def decode_entities(text: Column) -> Column:
    """Numeric character references, then amp, quot, #39, lt, gt in that order."""

    def numeric(s: Column, pattern: str, base: int) -> Column:
        refs = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))

        def one(acc: Column, ref: Column) -> Column:
            code = F.regexp_extract(ref, pattern, 1)
            number = F.conv(code, base, 16) if base != 16 else code
            return F.replace(acc, ref, F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32"))

        return F.when(s.contains("&#"), F.aggregate(F.array_distinct(refs), s, one)).otherwise(s)

    text = F.coalesce(text, F.lit(""))
    text = numeric(text, "(?i)&#x([0-9a-f]{1,6});?", 16)
    text = numeric(text, "&#([0-9]{1,7});?", 10)
    for ref, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


#: Characters that normalization keeps, in a form that Java and RE2 both read.
KEPT = r"\x{1100}-\x{11ff}\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{0600}-\x{06ff}\x{0400}-\x{04ff}a-z0-9\s:/._-"


def _quoted(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)


def literal_array(values) -> Column:
    """A constant array, parsed at once instead of built value by value."""
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def literal_map(pairs: dict) -> Column:
    """A constant map, parsed at once."""
    return F.expr(f"map({', '.join(_quoted(x) for pair in pairs.items() for x in pair)})")


def normalize(text: Column) -> Column:
    """Decoded, lower case, without marks, other characters as blanks, blanks squeezed."""
    marked, plain = accents()
    out = F.translate(F.lower(decode_entities(text)), marked, plain)
    out = F.regexp_replace(out, r"[\x{0300}-\x{036f}]", "")
    out = F.regexp_replace(out, f"[^{KEPT}]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def plain_word(word: str) -> str:
    """A word of a list as ``normalize`` would write it."""
    flat = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not "\u0300" <= c <= "\u036f")
    return " ".join(re.sub(r"[^\u1100-\u11ff\u3000-\u9fff\uac00-\ud7af\u0600-\u06ff\u0400-\u04ffa-z0-9\s:/._-]", " ",
            unicodedata.normalize("NFC", flat)).split())


_EDGE_BEFORE, _EDGE_AFTER = r"""(?:^|[\s\-_/.,;:!?"'()])""", r"""(?:[\s\-_/.,;:!?"'()]|$)"""


def keyword_patterns(words: list[str]) -> tuple[str, str]:
    """Two patterns of a word list: phrases that match anywhere, single words that match whole. Empty where there are none."""
    phrases = sorted({w for w in words if " " in w or "-" in w}, key=lambda w: (-len(w), w))
    singles = sorted({w for w in words if " " not in w and "-" not in w}, key=lambda w: (-len(w), w))
    anywhere = "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in phrases)
    whole = f"{_EDGE_BEFORE}(?:{'|'.join(map(re.escape, singles))}){_EDGE_AFTER}" if singles else ""
    return anywhere, whole


def has_keyword(normalized: Column, words: list[str]) -> Column:
    """Whether a normalized text holds any of the words; one pass for phrases and one for single words."""
    out = F.lit(False)
    for pattern in keyword_patterns(words):
        if pattern:
            out = out | normalized.rlike(pattern)
    return out


def keyword_hits(normalized: Column, words: list[str]) -> Column:
    """How many different words of the list a normalized text holds."""
    return sum((has_keyword(normalized, [w]).cast("int") for w in words), F.lit(0))


def has_term(lowered: Column, terms: list[str]) -> Column:
    """Whether a text holds any term as a substring."""
    return lowered.rlike("|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms))


def host(url: Column) -> Column:
    """Host name without a leading www., empty for what isn't a URL."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


#: Query parameters that identify an article, in their order.
KEPT_PARAMETERS = ("id", "article", "story", "news", "p", "pid")


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters, and without a final slash; other text is only trimmed."""
    scheme, name, path = (F.try_parse_url(url, F.lit(x)) for x in ("PROTOCOL", "HOST", "PATH"))
    kept = F.concat_ws("&", *(F.concat(F.lit(k + "="), F.try_parse_url(url, F.lit("QUERY"), F.lit(k))) for k in KEPT_PARAMETERS))
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    base = F.concat(F.lower(scheme), F.lit("://"), F.lower(name), port, F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path))
    whole = F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))
    return F.coalesce(F.regexp_replace(whole, "/$", ""), F.trim(F.coalesce(url, F.lit(""))))


def title_of_url(url: Column) -> Column:
    """The last path segment with three letters in a row, dashes as blanks; else the host."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.transform(
        F.reverse(F.split(path, "/")),
        lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\.[a-z0-9]{2,6}$", ""), r"[-_+%\s]+", " ")),
    )
    fit = F.filter(parts, lambda s: s.rlike("[a-zA-Z]{3,}"))
    return F.coalesce(F.get(fit, F.lit(0)), host(url))


def title_key(title: Column) -> Column:
    """Normalized title without long numbers and hashes, at most 140 characters."""
    out = F.regexp_replace(normalize(title), r"\b\d{5,}\b", " ")
    out = F.regexp_replace(out, r"\b[a-f0-9]{8,}\b", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, 140)


#: Words that don't mark a story.
STORY_STOPWORDS = (
    "after", "before", "first", "images", "historic", "historical", "mission", "returns", "return", "earth",
    "safely", "crew", "capsule", "lunar", "around", "travel", "journey", "where", "does", "from", "with",
)


def story_family(title: Column, bucket: Column, country: Column) -> Column:
    """Bucket, country and the first six telling words of a title; null where there are none."""
    words = F.filter(F.split(title_key(title), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STORY_STOPWORDS))
    words = F.slice(words, 1, 6)
    key = F.concat_ws("|", F.coalesce(bucket, F.lit("general")), F.coalesce(country, F.lit("UNK")), F.concat_ws("|", words))
    return F.when(F.size(words) > 0, key)


def split_list(field: Column, most: int = 12) -> Column:
    """Parts of a semicolon list, trimmed, without empty ones."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda x: F.trim(x)), lambda v: v != ""), 1, most)


def first_number(field: Column) -> Column:
    """The first entry of a comma list as a double, null if it isn't a finite number."""
    x = F.split(field, ",")[0].try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def page_title(extras: Column) -> Column:
    found = F.regexp_extract(F.coalesce(extras, F.lit("")), r"(?i)<PAGE_TITLE>([^<]{4,300})</PAGE_TITLE>", 1)
    return F.when(found != "", F.trim(F.regexp_replace(decode_entities(found), r"\s+", " ")))


def word_set(title: Column) -> Column:
    """Distinct ASCII words of a title, for ``overlap``."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_\s]", ""), r"\s+"))


def overlap(a: Column, b: Column) -> Column:
    """Common words over the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def long_words(title: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct unmarked words of more than three letters, for ``jaccard``."""
    marked, plain = accents()
    flat = F.regexp_replace(F.translate(F.lower(F.coalesce(title, F.lit(""))), marked, plain), "[^a-z0-9 ]", " ")
    keep = lambda w: (F.length(w) > 3) & (~w.isin(*stopwords) if stopwords else F.lit(True))
    return F.array_distinct(F.filter(F.split(flat, r"\s+"), keep))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def stamp(ts: Column) -> Column:
    """A 14-digit UTC stamp as a timestamp, null for anything else."""
    return F.when(ts.rlike(r"^\d{14}$"), F.try_to_timestamp(ts, F.lit("yyyyMMddHHmmss")))


# Path segments that are no titles, words of sections, and scripts that are native to where they are written.
NAVIGATION = (
    "view", "news", "article", "articles", "read", "story", "stories", "post", "posts",
    "page", "pages", "detail", "details", "content", "index", "home", "default",
    "category", "categories", "tag", "tags", "search", "author", "authors",
    "section", "topic", "topics", "latest", "breaking", "world", "politics",
    "national", "local", "international", "sports", "business", "technology",
    "opinion", "editorial", "comment", "comments", "html", "htm", "php", "aspx", "jsp",
    "en", "fr", "ru", "zh", "ar", "ko", "ja", "de", "es", "pt", "tr", "fa", "he",
    "update", "updates", "brief", "briefing", "briefings",
    "report", "reports", "coverage", "headline", "headlines",
    "alert", "alerts", "notice", "notices", "bulletin",
    "summary", "recap", "roundup", "digest",
    "live", "video", "photo", "photos", "gallery",
    "explainer", "analysis", "feature", "features",
)
SECTIONS = "(?i)^(world|local|global|middle|east|west|north|south|cross|strait|politics|business|technology|defense|opinion|commentary|analysis|life|travel|culture)$"
NATIVE = r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7af}\x{0600}-\x{06ff}\x{0400}-\x{04ff}]"
LEAST_NATIVE, LEAST_SINGLE, LEAST_TITLE, NATIVE_POINTS = 4, 12, 15, 500


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def scored_title(url: Column) -> Column:
    """The title that an address spells, null where it spells none.

    First a query parameter in a native script; else the path segment with the highest score, words with letters times length
    (more for native script), the first of equals. Navigation, numbers, hashes and single short words are no titles.
    """
    one_blank = lambda s, pattern: F.trim(F.regexp_replace(F.regexp_replace(s, pattern, " "), r"\s+", " "))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    values = F.transform(F.split(query, "&"), lambda p: _decoded(
            _decoded(F.replace(F.substring_index(p, "=", -1), F.lit("+"), F.lit(" ")))))
    told = F.filter(F.transform(values, lambda v: one_blank(decode_entities(v), "[+_]+")),
        lambda v: v.rlike(NATIVE) & (F.length(v) >= LEAST_NATIVE))

    segments = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")

    def cleaned(s: Column) -> Column:
        s = one_blank(F.regexp_replace(decode_entities(_decoded(s)), r"(?i)\.[a-z0-9]{2,6}$", ""), "[-_+%]+")
        return F.trim(F.regexp_replace(F.regexp_replace(s, r"(\s+\d+)+\s*$", ""), r"^\s*\d+\s+", ""))

    with_letters = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w.rlike("(?i)[a-z]{2,}"))
    generic = lambda w: F.lower(w).isin(*NAVIGATION) | w.rlike(SECTIONS)
    scored = F.transform(F.transform(segments, cleaned), lambda s, i: F.struct(s.alias("s"), with_letters(s).alias("w"), (-i).alias("i")))
    fit = F.filter(
        scored,
        lambda c: ~c["s"].rlike(r"^\d*$") & ~F.replace(c["s"], F.lit(" "), F.lit("")).rlike("(?i)^[0-9a-f]{16,64}$")
            & ~F.lower(c["s"]).isin(*NAVIGATION)
        & (F.size(c["w"]) > 0) & ((F.size(c["w"]) > 1) | (F.length(c["s"]) >= LEAST_SINGLE)) & F.exists(c["w"], lambda w: ~generic(w)),
    )
    points = lambda c: F.size(c["w"]) * F.length(c["s"]) + F.when(c["s"].rlike(NATIVE), NATIVE_POINTS).otherwise(0)
    best = F.array_max(F.transform(fit, lambda c: F.struct(points(c).alias("p"), c["i"].alias("i"), c["s"].alias("s"))))["s"]
    enough = (best.rlike(NATIVE) & (F.length(best) >= LEAST_NATIVE)) | (F.length(best) >= LEAST_TITLE) | (best.rlike("[a-zA-Z]{3,}")
        & best.contains(" "))
    return F.coalesce(F.get(told, F.lit(0)), F.when(enough, best))


# Names of event codes.
SUB_TYPES = {
    "130": "Threaten", "134": "Threaten with military force", "139": "Threaten with military attack",
    "141": "Demonstrate or rally", "145": "Protest violently, riot",
    "150": "Demonstrate military or police power", "154": "Mobilize or increase armed forces", "155": "Mobilize cyber forces",
    "160": "Reduce relations", "170": "Coerce",
    "180": "Use conventional military force", "181": "Abduct, hijack, or take hostage", "182": "Physically assault",
    "183": "Conduct bombing", "1831": "Carry out suicide bombing", "1832": "Carry out car bombing", "1833": "Carry out IED attack",
    "184": "Use conventional weapons", "185": "Employ aerial weapons", "186": "Violate ceasefire",
    "190": "Fight", "191": "Impose blockade, restrict movement", "192": "Occupy territory",
    "193": "Fight with small arms and light weapons", "194": "Fight with artillery and tanks",
    "195": "Employ aerial weapons", "196": "Violate ceasefire",
    "200": "Engage in mass violence", "202": "Engage in mass killings", "204": "Use weapons of mass destruction",
}


def sub_type(code: Column) -> Column:
    """The name of an event code, else of its first three or two characters, else Unknown."""
    names = literal_map(SUB_TYPES)
    return F.coalesce(*(F.try_element_at(names, F.substring(code, 1, n)) for n in (9, 3, 2)), F.lit("Unknown"))


def without_fences(text: Column) -> Column:
    """A provider's answer without the fences of a code block around it."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(out, r"\s*```$", ""))


#: Characters that change the state of the automaton in ``balanced_object``.
_MARKS = r"""[{}"\\]"""


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """What ``of`` makes of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def balanced_object(text: Column) -> Column:
    """The first JSON object of a text, from its first brace to the one that closes it; null where none is closed.

    One pass of an automaton over the marks only (braces, quotes, backslashes): it knows how deep it is, whether it is inside a
    string and whether the next character is escaped, and braces inside strings don't count. What lies between two marks only
    moves the position, so a long text costs a step a mark.
    """
    return _once(without_fences(text), lambda clean: _once(F.substr(clean, F.instr(clean, "{"), F.length(clean)), _closed))


def _closed(rest: Column) -> Column:
    """The object with which a text begins."""
    # pieces end at a mark each: the stretch before it, then the mark
    pieces = F.regexp_extract_all(rest, F.lit(r"""[^{}"\\]*[{}"\\]"""), F.lit(0))
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(-1).alias("escaped"),
        F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        mark = F.right(piece, F.lit(1))
        literal = s["inside"] & (s["escaped"] == at)  # the character right after a backslash
        quote = (mark == '"') & ~literal
        depth = s["depth"] + F.when(s["inside"] | (mark == '"') | (mark == "\\"), 0).when(mark == "{", 1).otherwise(-1)
        return F.struct(
            at.alias("at"), depth.alias("depth"), (s["inside"] != quote).alias("inside"),
            F.when(s["inside"] & (mark == "\\") & ~literal, at + 1).otherwise(F.lit(-1)).alias("escaped"),
            F.when(s["end"] > 0, s["end"]).when(~s["inside"] & (mark == "}") & (depth == 0), at).otherwise(0).alias("end"),
        )

    end = F.aggregate(pieces, first, step)["end"]
    return _once(end, lambda end: F.when(rest.startswith("{") & (end > 0), F.substr(rest, F.lit(1), end)))


def json_array(text: Column) -> Column:
    """The stretch from the first opening to the last closing bracket of a text, null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\[.*\]", 0)
    return F.nullif(found, F.lit(""))


SIGNAL = "location_name string, summary string, key_points array<struct<point string, category string>>"


def signal_answer(text: Column, most: int = 5) -> Column:
    """A provider's summary (location_name, summary, key_points), mended; null where no object can be read from it."""
    return answer_of(balanced_object(text), most)


def answer_of(found: Column, most: int = 5) -> Column:
    """The same, of the object that ``balanced_object`` found."""
    said = lambda c, other: F.trim(F.coalesce(c, F.lit(other)))

    def told(read: Column) -> Column:
        listed = F.slice(F.coalesce(read["key_points"], F.array().cast("array<struct<point string, category string>>")), 1, most)
        points = F.filter(F.transform(listed, lambda p: F.struct(said(p["point"], "").alias("point"),
                    F.lower(said(F.nullif(p["category"], F.lit("")), "conflict")).alias("category"))), lambda p: p["point"] != "")
        return F.struct(said(read["location_name"], "").alias("location_name"), said(read["summary"], "").alias("summary"),
            points.alias("key_points"))

    return _once(found, lambda o: F.when(F.try_parse_json(o).isNotNull(), _once(F.from_json(o, SIGNAL, {"mode": "PERMISSIVE"}), told)))
