"""Operator 10: main text of web pages, with site templates removed.

Element subtrees (name, classes and text, children in order), inside an article or
not, are hashed on every page. A subtree that stands on ``LEAST_PAGES`` different
pages of its host belongs to the site's template and is deleted with all below it;
pages with the same main text count as one, so copies of a page make no template.
A subtree that holds an article or nearly all of its page's text is never one, and
where templates would take nearly all text of a page together, they take none of it.
Recurrence can't tell what differs from page to page (adverts, reader comments, a
site's first pages), so beside it elements that say by name, role, class or id that
they are menus, headers, footers, side bars, notices, adverts, forms or comments are
deleted, and if a page has ``article`` or ``main`` elements their text is the main
text, otherwise that of the body. A name is a weak reason: a form, or an element that only
its class or id speaks against, stays if it holds over half of the main text, and never
takes an article with it; an article that its own class speaks against is one if the page
has no other and it holds over half of the text. If names leave nothing, they delete
nothing. ``hints=False`` leaves these out, and recurrence alone decides. Scripts, styles
and other elements without text always go.

White space inside a block becomes one space, and
blocks are joined by one space in page order.

A page is joined to those of its own subtrees that are templates, so what a page
carries is bounded by its own elements, however many templates its host has.

Null or empty html gives empty text. A page with a null or unreadable url has no host,
so no templates. Repeated rows each give a row. Broken markup is read as far as it goes: a
closing tag closes all that is open inside its element, the end of the page closes all,
and a quote that no attribute's end follows belongs to its value.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import map_batches, Stage

#: A subtree is template if it stands on so many different pages of its host, whatever the number of its pages.
LEAST_PAGES = 5
#: Templates never take this share of a page's main text or more.
NEARLY_ALL = 0.8

_WORDS = "address area base br col embed hr img input link meta param source track wbr"
VOID = frozenset(_WORDS.split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements whose text isn't shown as text of the page.
TEXTLESS = frozenset(
    "script style noscript template svg math head title select option datalist textarea input iframe object embed canvas audio video map noembed noframes xmp".split())
DROPPED = TEXTLESS | frozenset("nav footer aside form button dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br input".split()
)
#: Elements that go with all below them, articles too.
CLOSED = DROPPED - {"form"}
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that name what isn't article text, anywhere and only outside an article.
ANYWHERE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner comment comments "
    "commentlist disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup popup modal overlay cookie cookies consent gdpr sidebar widget breadcrumb breadcrumbs pagination pager "
    "nav navbar navigation menu teaser teasers".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
OUTSIDE = ANYWHERE | frozenset(
    "header masthead topbar footer bottombar side aside notice notices alert toolbar skip copyright legal login search".split())

#: A tag ends at the next > outside quoted values; a < before that means that it was none. A value is quoted only if a blank, a slash
#: or the tag's end follows its second quote.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/><]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s<>]*+))*+)>",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(attributes: str) -> tuple[frozenset[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words, role, hidden = [], "", False
    for m in _ATTRIBUTE.finditer(attributes):
        if m.start() and not attributes[m.start() - 1].isspace():
            continue
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id"):
            words += _NAME_PARTS.findall(_CAMEL.sub(" ", value).lower())
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return frozenset(words), role, hidden


class _Element:
    __slots__ = ("name", "dropped", "inside", "hash", "first", "holds", "blocked", "weak")

    def __init__(self, name: str, dropped: bool, inside: bool, digest, first: int, holds: bool, blocked: bool, weak: int):
        self.name, self.dropped, self.inside, self.hash, self.first, self.holds, self.blocked = name, dropped, inside, digest, first, holds, blocked
        self.weak = weak  # the nearest element around the text that a name speaks against, -1 for none


class Page:
    """Blocks of text in page order and the subtrees that may be template, by one pass over the tags.

    ``blocks``: [text, inside an article, the nearest element that a name speaks against]; ``weak``: of each such element the
    one around it, and whether it is an article. ``containers``: (hash, first block, end of blocks). ``kept``: the main text.
    """

    def __init__(self, source: str, hints: bool = True):
        self.hints = hints
        self.names: Counter[str] = Counter()  # of the open elements
        self.blocks: list[list] = []
        self.containers: list[tuple[int, int, int]] = []
        self.has_article = False
        self.weak: list[tuple[int, bool]] = []
        self.open: list[_Element] = []
        self.pending: list[str] = []
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m.group(1)
            if name is None:
                continue
            name = name.lower()
            if source[m.start() + 1] == "/":
                self._close(name)
                continue
            self._start(name, m.group(2) or "")
            if name in RAW and not (m.group(2) or "").endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                if stop is None:
                    at = n
                else:
                    at = stop.end()
                    self._close(name)
        while self.open:
            self._pop()
        self._flush()
        self.kept = self._main_text()
        self.sizes = [len(t) + 1 if stays else 0 for (t, _, _), stays in zip(self.blocks, self.kept, strict=True)]
        self.before = list(accumulate(self.sizes, initial=0))
        most = NEARLY_ALL * self.before[-1]
        self.containers = [c for c in self.containers if 0 < self.before[c[2]] - self.before[c[1]] < most]

    def _weighed(self, counts: list[bool]) -> tuple[list[int], int]:
        """Characters of the blocks that count in each element that a name speaks against, and in all."""
        held, total = [0] * len(self.weak), 0
        for (text, _, weak), yes in zip(self.blocks, counts, strict=True):
            if yes:
                total += len(text) + 1
                if weak >= 0:
                    held[weak] += len(text) + 1
        for i in range(len(held) - 1, -1, -1):  # what is around an element has a lower number
            if self.weak[i][0] >= 0:
                held[self.weak[i][0]] += held[i]
        return held, total

    def _within(self, marked: list[bool]) -> list[bool]:
        """Of each element that a name speaks against, whether it or one around it is marked."""
        out: list[bool] = []
        for (above, _), mark in zip(self.weak, marked, strict=True):
            out.append(mark or above >= 0 and out[above])
        return out

    def _main_text(self) -> list[bool]:
        """Which blocks are main text, before templates are known."""
        counts = [inside or not self.has_article for _, inside, _ in self.blocks]
        if not self.weak:
            return counts
        if not self.has_article:
            held, total = self._weighed(counts)
            large = [i for i, (_, article) in enumerate(self.weak) if article and 2 * held[i] > total]
            if large:  # the innermost of several
                own = self._within([i == large[-1] for i in range(len(self.weak))])
                counts, self.has_article = [weak >= 0 and own[weak] for _, _, weak in self.blocks], True
        held, total = self._weighed(counts)
        gone = self._within([2 * n <= total for n in held])
        left = [yes and not (weak >= 0 and gone[weak]) for yes, (_, _, weak) in zip(counts, self.blocks, strict=True)]
        return left if any(left) else counts

    def _text(self, text: str) -> None:
        if self.open and self.open[-1].dropped:
            self.open[-1].hash.update(text.encode("utf-8", "replace"))
        else:
            self.pending.append(text)

    def _flush(self) -> None:
        """End the block under way."""
        if self.pending:
            text = " ".join(html.unescape("".join(self.pending)).split())
            self.pending.clear()
            if text:
                inside = bool(self.open) and self.open[-1].inside
                self.blocks.append([text, inside, self.open[-1].weak if self.open else -1])
                if self.open:
                    self.open[-1].hash.update(text.encode("utf-8", "replace"))

    def _push(self, element: _Element) -> None:
        self.open.append(element)
        self.names[element.name] += 1

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            if not (self.open and self.open[-1].dropped):
                self.pending.append(" ")
            return
        above = self.open[-1] if self.open else None
        if name in INLINE and not attributes.strip(" /") or name in VOID:
            if name not in INLINE:
                self._flush()
            if name in VOID or above is None:
                return
            # plain inline marks only need to be there for their closing tag
            self._push(_Element(name, above.dropped, above.inside, above.hash, -1, False, above.blocked, above.weak))
            return
        if name not in INLINE:
            self._flush()
        words, role, hidden = _named(attributes) if attributes else (frozenset(), "", False)
        inside = above is not None and above.inside
        dropped = above is not None and above.dropped
        weak = above.weak if above is not None else -1
        holds = against = False
        if self.hints and (name in ARTICLE or role == "main"):
            # an article lifts what an element around it would have dropped, unless that takes articles too
            if not (above is not None and above.blocked):
                dropped = False
                if words & ANYWHERE:
                    weak = self._speak_against(weak, True)
                else:
                    inside = holds = self.has_article = True
                    weak = -1
        if not self.hints:
            dropped = dropped or name in TEXTLESS
        elif not dropped and name not in ("html", "body"):
            named = bool(words & (ANYWHERE if inside else OUTSIDE)) and name not in ARTICLE
            dropped = name in CLOSED or hidden or role in ROLES or name == "header" and not inside or named and (name in INLINE
                or bool(words & COMMENTS))
            against = not dropped and (named or name == "form")
            if against:
                weak = self._speak_against(weak, False)
        digest = blake2b(f"{name} {' '.join(sorted(words))}".encode("utf-8", "replace"), digest_size=8)
        blocked = above is not None and above.blocked or dropped and (name in CLOSED or inside) or against and inside
        self._push(_Element(name, dropped, inside, digest, len(self.blocks), holds, blocked, weak))

    def _speak_against(self, above: int, article: bool) -> int:
        self.weak.append((above, article))
        return len(self.weak) - 1

    def _close(self, name: str) -> None:
        if name not in INLINE:
            if name in VOID or not self.names[name]:
                return
            self._flush()
            while self.open[-1].name != name:
                self._pop()
            self._pop()
        elif self.open and self.open[-1].name == name:
            self._pop()

    def _pop(self) -> None:
        element = self.open[-1]
        if element.first >= 0 and element.name not in INLINE:
            self._flush()
        self.open.pop()
        self.names[element.name] -= 1
        if element.first < 0:  # a plain inline mark
            if self.open:
                self.open[-1].holds |= element.holds
            return
        digest = element.hash.digest()
        above = self.open[-1] if self.open else None
        if above is not None:
            above.hash.update(digest)
            above.holds |= element.holds
        if not element.dropped and not element.holds and element.name not in INLINE and len(self.blocks) > element.first:
            self.containers.append((int.from_bytes(digest, "little", signed=True), element.first, len(self.blocks)))

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        steps = [0] * (len(self.blocks) + 1)
        for digest, first, end in self.containers:
            if digest in templates:
                steps[first] += 1
                steps[end] -= 1
        kept = [not depth for depth in accumulate(steps)][: len(self.blocks)]  # by templates, of what is main text
        if sum(n for n, stays in zip(self.sizes, kept, strict=True) if not stays) >= NEARLY_ALL * self.before[-1]:
            kept = [True] * len(self.blocks)
        return " ".join(t for (t, _, _), stays, main in zip(self.blocks, kept, self.kept, strict=True) if stays and main)


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return pages.withColumn("host", host)


def page_subtrees(pages: DataFrame, hints: bool = True) -> DataFrame:
    """For rows (host, node, html): host, node, the hash of the main text, and those of the subtrees that may be template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, digests = [], []
            for source in batch.column(2).to_pylist():
                page = Page(source or "", hints)
                same.append(int.from_bytes(blake2b(page.text().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                digests.append(sorted({c[0] for c in page.containers}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(same, pa.int64()), pa.array(digests, pa.list_(pa.int64()))],
                    ["host", "node", "same", "digests"]
            )

    return pages.select("host", "node", "html").transform(map_batches, run, "host string, node long, same long, digests array<long>")


def site_templates(subtrees: DataFrame) -> DataFrame:
    """(host, digest) of the subtrees that recur on many different pages of a host."""
    once = subtrees.where("host <> ''").groupBy("host", "same").agg(F.min_by("digests", "node").alias("digests"))
    return once.select("host", F.explode("digests").alias("digest")).groupBy("host",
        "digest").count().where(F.col("count") >= LEAST_PAGES).select("host", "digest")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """(page_id, url, text) of every page; without ``hints`` by recurrence alone."""
    rows = with_host(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    rows = rows.withColumn("node", F.xxhash64("html"))
    subtrees = Stage(pages.sparkSession, "pages").keep(page_subtrees(rows, hints), "subtrees")
    own = subtrees.groupBy("host", "node").agg(F.first("digests").alias("digests")).select("host", "node",
        F.explode("digests").alias("digest"))
    templates = own.join(site_templates(subtrees), ["host", "digest"]).groupBy("host",
        "node").agg(F.sort_array(F.collect_list("digest")).alias("templates"))
    joined = rows.join(templates, ["host", "node"], "left").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(source or "", hints).text(frozenset(own or ()))
                for source, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.transform(map_batches, run, "page_id long, url string, text string")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    text = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
