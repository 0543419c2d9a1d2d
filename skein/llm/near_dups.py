"""Operator 9: near duplicates by Order MinHash.

A sketch of a text takes, under one random order, the ``PICKS`` smallest of its
occurrence-labelled word k-mers and hashes them in the order in which they stand
in the text; two texts share it with a chance that follows their edit similarity
and not only their sets of k-mers. Texts in one bucket, of which at least
``AGREEING`` of ``SKETCHES`` sketches agree, are candidates. Two texts are linked if the
similarity of their sets of ``K``-word shingles (twice those in common over the sum of
both) is at least ``SIMILARITY`` and a banded alignment of their words needs edits of at
most (1 - SIMILARITY) of the longer text. Classes are the connected components of the
links. All pairs with 0.8 of their united shingles in common are well inside that.

A pair of long texts fails to be a candidate about once in 20 000 cases where 0.8 of the
united shingles are common, and 7 times in 100 at the very edge of the threshold (12 for
texts of 13 to 30 shingles). Texts of few shingles share too few of them for that, so texts of at most ``SHORT`` different
shingles also meet exactly: ordered by how rare they are, two such texts of enough
similarity share one of the first few of each.

Equal texts are one node from the start, so a copied text costs one row however
often it occurs. In a sketch's bucket texts are first aligned with one hub (the
most central hub of all their buckets, then those that their class doesn't hold yet); what
still stands outside the bucket's main class is then held against every text of
another class in it. No bucket is capped, and a large group of copies needs no
pairs within itself.

Words are runs of non-blank characters with A to Z lower-cased. A text of fewer
than ``K`` words is one k-mer. Null text counts as empty, as does one of blanks only,
so all texts without words are one class. ``class_id`` is the least ``doc_id`` of the class (null only
if all are); repeated rows each get their row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import edit_distances
from .graph import components
from .kernels import LOWER, U64, binary_column, groups, mix, run_ranks, span_hashes, spans, text_bytes
from .storage import map_batches, Stage

K = 5
PICKS = 5
SKETCHES = 32
SIMILARITY = 0.8
#: Sketches that must agree (judged by their low bytes) before two texts of a bucket are aligned.
AGREEING = 2
#: Different shingles up to which texts also meet by their rarest shingles.
SHORT = 12
#: Classes of shingles that are counted (to 127), for a lower bound of how many two texts don't share.
BINS = 256


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the row of each."""
    raw = LOWER[raw]
    starts, ends, rows = spans(raw, offsets)
    return span_hashes(raw, starts, ends), rows


def labelled_kmers(hashes: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-mers with their occurrence number, in text order, the row of each, and the hash and row of each row's different ones."""
    counts = np.bincount(rows, minlength=n)
    begins = np.cumsum(counts) - counts
    whole = np.minimum(counts, k)
    place = np.arange(len(rows)) - begins[rows]
    at = np.flatnonzero(place <= counts[rows] - whole[rows])
    kmers = np.zeros(len(at), U64)
    for j in range(k):
        kmers *= U64(0x9FB21C651E98DF25)
        inside = at + j
        last = begins[rows[at]] + counts[rows[at]]
        ok = inside < last
        kmers[ok] += hashes[inside[ok]]
    kmers, row = mix(kmers), rows[at]
    plain, first = kmers.copy(), np.ones(len(at), bool)
    keyed = kmers ^ mix(row.astype(U64) + U64(0x51ED270B))
    order = np.argsort(keyed)
    ordered = keyed[order]
    again = np.zeros(len(at), bool)
    again[1:] = ordered[1:] == ordered[:-1]
    if again.any():
        again[:-1] |= again[1:]
        some = np.sort(order[again])  # in text order, so that a stable sort numbers occurrences
        by = some[np.argsort(keyed[some], kind="stable")]
        number = run_ranks(keyed[by])
        first[by] = number == 0
        kmers[by] = mix(kmers[by] + number.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return kmers, row, plain[first], row[first]


def order_sketches(kmers: np.ndarray, row: np.ndarray, n: int, picks: int = PICKS, sketches: int = SKETCHES) -> np.ndarray:
    """An n x sketches table of labelled k-mers; rows without any are zero."""
    out = np.zeros((n, sketches), U64)
    if not len(row):
        return out
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    some, length = row[begin], np.diff(np.append(begin, len(row)))
    top = U64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        seeds = mix(np.array([2 * s + 1, 2 * s + 2], U64))
        rank = (kmers ^ seeds[0]) * (seeds[1] | U64(1))
        rank ^= rank >> U64(32)
        rank *= U64(0xD6E8FEB86659FD93)
        rank ^= rank >> U64(29)
        chosen = np.full((len(begin), picks), len(row), np.int64)
        for p in range(picks):
            least = np.minimum.reduceat(rank, begin)
            hit = np.flatnonzero((rank == np.repeat(least, length)) & (rank != top))
            who = np.searchsorted(begin, hit, "right") - 1
            chosen[who[::-1], p] = hit[::-1]  # the first in the text, were there two
            rank[hit] = top
        chosen.sort(axis=1)
        value = np.full(len(begin), seeds[0])
        for p in range(picks):
            there = chosen[:, p] < len(row)
            value[there] = mix(value[there] * U64(0x9E3779B97F4A7C15) + kmers[chosen[there, p]])
        out[some, s] = value
    return out


def short_shingles(found: np.ndarray, row: np.ndarray, n: int) -> list:
    """The different shingles of each row, null where they are none or more than ``SHORT``."""
    out = [None] * n
    counts = np.bincount(row, minlength=n)
    ends = np.cumsum(counts)
    for i in np.flatnonzero((counts > 0) & (counts <= SHORT)).tolist():
        out[i] = found[ends[i] - counts[i] : ends[i]].view(np.int64)
    return out


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """The different shingles of a text's 32-bit word hashes; fewer than ``k`` words are one shingle."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, U64)
    at = len(words) - k + 1
    found = np.zeros(at, U64)
    for j in range(k):
        found = found * U64(0x9FB21C651E98DF25) + words[j : j + at]
    return np.unique(mix(found))


def shingle_similarity(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Twice the common shingles of two texts, given as word hashes, over the sum of both; two empty texts are alike."""
    a, b = shingles(x, k), shingles(y, k)
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) or len(b) else 1.0


def sketch_texts(docs: DataFrame) -> DataFrame:
    """For rows (id, node, text): id, node, the numbers of words, of different shingles and of those of each class, the sketches, and few shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in groups(offsets, 1 << 20):
                part = offsets[i : j + 1]
                hashes, rows = _words(raw[part[0] : part[-1]], part - part[0])
                kmers, row, different, its_row = labelled_kmers(hashes, rows, j - i, K)
                table = order_sketches(kmers, row, j - i)
                bins = np.bincount(its_row * BINS + (different % U64(BINS)).astype(np.int64), minlength=(j - i) * BINS).reshape(-1, BINS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(np.bincount(rows, minlength=j - i)),
                        pa.array(np.bincount(its_row, minlength=j - i)),
                        pa.array(list(np.minimum(bins, 127).astype(np.int8)), pa.list_(pa.int8())),
                        pa.array(list(table.view(np.int64)), pa.list_(pa.int64())),
                        pa.array(short_shingles(different, its_row, j - i), pa.list_(pa.int64())),
                    ],
                    ["id", "node", "n_words", "n_shingles", "bins", "sketches", "short"],
                )

    return docs.select("id", "node", "text").transform(map_batches, run,
        "id long, node string, n_words long, n_shingles long, bins array<tinyint>, sketches array<long>, short array<long>")


def word_lists(texts: DataFrame) -> DataFrame:
    """For rows (nid, text): nid and the 32-bit hashes of its words as a binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in groups(offsets):
                part = offsets[i : j + 1]
                hashes, rows = _words(raw[part[0] : part[-1]], part - part[0])
                words = binary_column(hashes.astype(np.uint32), np.bincount(rows, minlength=j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), words], ["nid", "words"])

    return texts.select("nid", "text").transform(map_batches, run, "nid long, words binary")


def verified(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (x, y), as (a, b), whose shingles are similar enough and whose words align within the edit budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                both = [
                    tuple(np.frombuffer(x.as_buffer(), np.uint32) for x in pair)
                    for pair in zip(part.column(2), part.column(3), strict=True)
                ]
                ok = np.array([shingle_similarity(x, y) >= similarity - 1e-9 for x, y in both], bool)
                like = [pair for pair, good in zip(both, ok.tolist(), strict=True) if good]
                limits = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in like]
                ok[ok] = edit_distances(like, limits) <= np.array(limits, np.int64)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    left = words.select(F.col("nid").alias("a"), F.col("words").alias("words_a"))
    right = words.select(F.col("nid").alias("b"), F.col("words").alias("words_b"))
    rows = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).join(left, "a").join(right, "b").select("a", "b", "words_a",
        "words_b")
    return rows.transform(map_batches, run, "a long, b long")


def _signature(sketches) -> list:
    """Low bytes of the sketches, seven to a long."""
    lanes = [F.shiftleft(F.get(sketches, F.lit(i)).bitwiseAND(F.lit(255)), 8 * (i % 7)) for i in range(SKETCHES)]
    out = []
    for i in range(0, SKETCHES, 7):
        word = lanes[i]
        for lane in lanes[i + 1 : i + 7]:
            word = word.bitwiseOR(lane)
        out.append(word.alias(f"s{i // 7}"))
    return out


_WORDS = -(-SKETCHES // 7)
_SEVENS = 0x007F7F7F7F7F7F7F


def _agreeing(a: str, b: str):
    """How many low bytes of two signatures are equal: the zero bytes of their exclusive or."""
    total = F.lit(0)
    for i in range(_WORDS):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        marks = sum(0x80 << 8 * lane for lane in range(min(7, SKETCHES - 7 * i)))
        carried = (x.bitwiseAND(F.lit(_SEVENS)) + F.lit(_SEVENS)).bitwiseOR(x)
        total = total + F.bit_count(F.bitwise_not(carried).bitwiseAND(F.lit(marks)))
    return total


def _alike(similarity: float):
    """What two texts of enough similarity have in common as far as lengths, signatures and shingle counts tell.

    A class of which one text has more shingles than the other holds shingles that they don't share, so the counts
    bound from below how many those are.
    """
    longest = F.greatest("x_words", "y_words") * similarity <= F.least("x_words", "y_words") + 1e-9
    apart = F.aggregate(F.zip_with("x_bins", "y_bins", lambda a, b: F.abs(a.cast("int") - b)), F.lit(0), lambda s, x: s + x)
    most = (F.col("x_shingles") + F.col("y_shingles")) * (1 - similarity) + 1e-9
    agreeing = (_agreeing("x_s", "y_s") >= AGREEING) | (F.col("x_short") & F.col("y_short"))
    return longest & agreeing & (apart <= most)


def _as(texts: DataFrame, name: str) -> DataFrame:
    return texts.select(F.col("nid").alias(name), F.col("n_words").alias(f"{name}_words"), F.col("n_shingles").alias(f"{name}_shingles"),
        F.col("bins").alias(f"{name}_bins"), F.col("short").isNotNull().alias(f"{name}_short"),
        *(F.col(f"s{i}").alias(f"{name}_s{i}") for i in range(_WORDS)))


def rare_shingles(texts: DataFrame, similarity: float) -> DataFrame:
    """(nid, number, value): of each text of few shingles the rarest, one of which any similar text of few shingles has too."""
    each = texts.where("short is not null").select("nid", F.explode("short").alias("value"))
    often = each.groupBy("value").agg(F.count("*").alias("n"))
    ranked = each.join(often, "value").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("ranked"))
    # the smaller of two similar sets has similarity / (2 - similarity) of the other's shingles at least, all in common then
    n, least = F.size("ranked"), similarity / (2 - similarity)
    head = F.slice("ranked", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    return ranked.select("nid", F.lit(SKETCHES).alias("number"), F.explode(head).alias("h")).select("nid", "number", "h.value")


#: Tasks that the texts of one class are dealt out to.
SALTS = 16
#: Distinct texts up to which the list of those to align is broadcast; beyond it is joined by a shuffle.
BROADCAST_TEXTS = 200_000


def _aligned(pairs: DataFrame, texts: DataFrame, rows: DataFrame, stage: Stage, name: str, similarity: float) -> DataFrame:
    """The pairs (x, y) that an alignment of their words confirms, as (a, b)."""
    pairs = stage.keep(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("x").alias("nid")).union(pairs.select(F.col("y").alias("nid"))).distinct()
    wanted = stage.keep(texts.select("nid", "node").join(ids, "nid"), f"{name}-texts")
    few = wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    once = rows if few else rows.groupBy("node").agg(F.first("text").alias("text"))  # a copied text is sent once a task
    found = once.join(F.broadcast(wanted) if few else wanted, "node").groupBy("nid").agg(F.first("text").alias("text"))
    words = stage.keep(word_lists(found), f"{name}-words")
    return stage.keep(verified(pairs, words, similarity), f"{name}-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, node (the md5 of its exact text) and class_node."""
    spark = docs.sparkSession
    stage = Stage(spark, "near-dups")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("node", F.md5("text"))
    sketched = stage.keep(sketch_texts(rows), "sketched")
    once = sketched.groupBy("node").agg(F.min("id").alias("least_id"), F.first("n_words").alias("n_words"),
        F.first("n_shingles").alias("n_shingles"), F.first("bins").alias("bins"), F.first("sketches").alias("sketches"),
        F.first("short").alias("short"))
    texts = stage.keep(once.select("node", "least_id", "n_words", "n_shingles", "bins", "sketches", "short",
            *_signature(F.col("sketches"))).withColumn("nid", F.monotonically_increasing_id()), "texts")

    # a sketch's value also depends on its number, so the value alone names the bucket
    member = texts.where("n_words > 0").select("nid", F.posexplode("sketches").alias("number", "value"))
    member = member.unionByName(rare_shingles(texts, similarity))
    sizes = member.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    met = stage.keep(member.join(sizes, "value"), "met")
    # the hub of a bucket is the text that shares the most: what others were made from shares all its sketches with many
    central = stage.keep(met.groupBy("nid").agg(F.sum("n").alias("central")), "central")
    hubs = met.join(central, "nid").groupBy("value").agg(F.max(F.struct("central", -F.col("nid"))).alias("h")).select("value",
        (-F.col("h.col2")).alias("hub"))
    shared = stage.keep(met.select("nid", "number", "value").join(hubs, "value"), "shared")

    # first each text with the most central hub of its buckets, then with the other hubs that its class doesn't hold yet
    hubbed = shared.where("nid <> hub").select(F.col("nid").alias("x"), F.col("hub").alias("y")).distinct()
    seen = hubbed.join(_as(texts, "x"), "x")
    alike = seen.join(_as(texts, "y"), "y").where(_alike(similarity)).select("x", "y")
    alike = stage.keep(alike.join(central.select(F.col("nid").alias("y"), "central"), "y"), "alike")
    least = alike.groupBy("x").agg(F.max_by("y", F.struct("central", -F.col("y"))).alias("y"))
    links = _aligned(least, texts, rows, stage, "first", similarity)
    roots = components(links, stage, "first")
    rooted = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = F.coalesce("x_root", "x") != F.coalesce("y_root", "y")
    others = alike.join(rooted("x"), "x", "left").join(rooted("y"), "y", "left").where(apart).select("x", "y")
    others = stage.keep(others.join(least, ["x", "y"], "left_anti"), "others")
    if not others.isEmpty():
        more = _aligned(others, texts, rows, stage, "second", similarity)
        roots = components(more, stage, "second", roots)

    # what stands outside the main class of its bucket is held against all other classes there, each pair in its first bucket
    placed = shared.join(roots, shared.nid == roots.node, "left").select("number", "value", "nid", "hub",
        F.coalesce("root", "nid").alias("root"))
    mixed = placed.groupBy("value", "root").agg(F.count("*").alias("n")).groupBy("value").agg(F.max(F.struct("n", "root")).alias("main"),
        F.count("*").alias("classes"))
    mixed = mixed.where("classes > 1").select("value", F.col("main.root").alias("main"))
    within = stage.keep(placed.join(mixed, "value"), "within")
    if not within.isEmpty():
        sign = within.join(texts.select("nid", "n_words", "n_shingles", "bins", "sketches", "short", *(f"s{i}" for i in range(_WORDS))),
            "nid")
        side = lambda n: [F.col("nid").alias(n), F.col("root").alias(f"{n}_root"), F.col("n_words").alias(f"{n}_words"),
            F.col("n_shingles").alias(f"{n}_shingles"), F.col("bins").alias(f"{n}_bins"), F.col("short").isNotNull().alias(f"{n}_short"),
            F.col("sketches").alias(f"{n}_sketches"), *(F.col(f"s{i}").alias(f"{n}_s{i}") for i in range(_WORDS))]
        outside = sign.where("root <> main").where("nid <> hub").select("value", "number", *side("x"))
        inside = sign.where("nid <> hub").select("value", "main", *side("y"))
        once_each = (F.col("y_root") == F.col("main")) | (F.col("x") < F.col("y"))
        first = F.array_position(F.zip_with("x_sketches", "y_sketches", lambda a, b: a == b), True) == F.col("number") + 1
        first = first | (F.col("number") == SKETCHES)
        cross = outside.join(inside, "value").where((F.col("x_root") != F.col("y_root")) & once_each & _alike(similarity) & first)
        cross = stage.keep(cross.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cross")
        if not cross.isEmpty():
            roots = components(_aligned(cross, texts, rows, stage, "third", similarity), stage, "third", roots)

    for name in ("met", "central", "shared", "alike", "others", "within"):  # no later step reads these
        stage.drop(name)
    classes = texts.select("node", "nid", "least_id").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    classes = classes.select("node", "least_id", F.coalesce("root", "nid").alias("class_node"), F.pmod("nid", F.lit(SALTS)).alias("salt"))
    # only classes of several texts have a name to look up, and a large one looks it up in several tasks
    several = classes.join(roots.select(F.col("root").alias("class_node")).distinct(), "class_node", "left_semi")
    names = several.groupBy("class_node").agg(F.min("least_id").alias("class_id"))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = classes.join(names, ["class_node", "salt"], "left").select("node", "class_node",
        F.coalesce("class_id", "least_id").alias("class_id"))
    return sketched.select(F.col("id").alias("doc_id"), "node").join(named, "node")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id")
