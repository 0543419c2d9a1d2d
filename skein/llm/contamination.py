"""Operator 4: benchmark passages in documents, by q-gram lemma filtering.

An item of L characters within e edits of a stretch of text shares at least
L - q + 1 - q*e of its q-grams with it, all on diagonals (place in the text less
place in the item) that differ by at most e. Shared q-grams are counted in
diagonal bands of 2(e+1) that overlap by half, bands that reach the bound keep
their region of the text, and a banded alignment of item and region decides.

Texts and items are compared as lower-cased characters (code points) with runs of
ASCII white space as one space; e is ``EDITS`` of the item's length, or less where the
bound would fall below one. q-grams are counted on characters folded to a byte each:
equal characters have equal bytes, so folding loses no shared q-gram, and the
alignment compares the characters themselves. The benchmark is read in blocks of a
fixed size, each broadcast and held against all documents; nothing is capped.

Items of fewer than ``SHORTEST`` characters are no evidence and never match, nor
do items whose text is null; a null item id is given as null. Null text is empty and matches nothing. Repeated rows each give
their own matches; equal items each match. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import contained_distances
from .kernels import SPACE, U64, HashTable, groups, text_bytes
from .storage import map_batches

Q = 8
EDITS = 0.1
SHORTEST = 24
#: Characters of benchmark text that are indexed and broadcast at a time.
BLOCK_UNITS = 4 << 20
_FILTER_BITS = 22


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 texts end to end, and the offsets in them; ASCII stays bytes."""
    if not len(raw) or raw.max() < 128:
        return raw, offsets
    starts = (raw & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=before[1:])
    at = np.flatnonzero(starts)
    lead = raw[at]
    more = (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    out = (lead & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint8)[more]).astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(more >= k)
        out[some] = out[some] << 6 | raw[np.minimum(at[some] + k, len(raw) - 1)] & 0x3F
    return out, before[offsets]


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts with each run of white space as one space, and offsets."""
    raw, offsets = code_points(*text_bytes(pc.utf8_lower(column)))
    blank = SPACE[np.minimum(raw, 255)]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    own = offsets[:-1][np.diff(offsets) > 0]
    keep[own] = ~blank[own]
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    out = raw[keep]
    out[blank[keep]] = 32
    return out, before[offsets]


def folded(characters: np.ndarray) -> np.ndarray:
    """A byte for each character, ASCII as it is."""
    if characters.dtype == np.uint8:
        return characters
    return np.where(characters < 128, characters, 128 + (characters * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.uint8)


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all 8-byte grams within rows, and the grams as numbers."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    keys = np.empty(n, U64)
    for r in range(min(Q, n)):
        count = (n - r + Q - 1) // Q
        keys[r::Q] = np.frombuffer(raw[r : r + count * Q].tobytes(), "<u8")
    inside = np.ones(n, bool)
    for back in range(1, Q):
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return at, keys[at]


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - _FILTER_BITS)).astype(np.int64)


class PassageIndex:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS):
        raw, offsets = normalized(pa.array([t for _, t in items], pa.string()))
        texts = [raw[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        texts = [t[int(t[:1].sum() == 32) : len(t) - int(t[-1:].sum() == 32)] for t in texts]
        kept = [(i, t) for (i, _), t in zip(items, texts, strict=True) if len(t) >= SHORTEST]
        self.ids = pa.array([i for i, _ in kept], pa.int64())
        self.texts = [t.astype(np.int64) for _, t in kept]
        length = np.array([len(t) for _, t in kept], np.int64)
        self.edits = np.minimum((edits * length).astype(np.int64), (length - Q) // Q)
        self.needed = length - Q + 1 - Q * self.edits
        self.length = length
        if not len(kept):
            return
        offsets = np.concatenate([[0], np.cumsum(length)])
        at, keys = grams(folded(np.concatenate([t for _, t in kept])), offsets)
        item = np.searchsorted(offsets, at, "right") - 1
        order = np.argsort(keys, kind="stable")
        distinct, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], (at - offsets[item])[order]
        self.table = HashTable(distinct)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slots(distinct)] = True

    def _regions(self, raw: np.ndarray, offsets: np.ndarray, most_hits: int = 4 << 20):
        """Rows, items and first diagonals of all bands that reach their bound."""
        at, keys = grams(raw, offsets)
        maybe = self.filter[_slots(keys)]
        at, keys = at[maybe], keys[maybe]
        found = self.table.find(keys)
        at, found = at[found >= 0], found[found >= 0]
        row = np.searchsorted(offsets, at, "right") - 1
        at = at - offsets[row]
        n_items, shift = len(self.ids), int(self.length.max())
        cells = int(np.diff(offsets).max(initial=0)) + 2 * shift + 2
        counts = self.count[found]
        edge = np.concatenate([[0], np.cumsum(counts)])
        keys, numbers = [], []
        for i, j in groups(edge, most_hits):
            hits = np.repeat(self.first[found[i:j]] - edge[i:j] + edge[i], counts[i:j]) + np.arange(edge[j] - edge[i])
            item = self.item[hits]
            diagonal = np.repeat(at[i:j], counts[i:j]) - self.place[hits] + shift
            cell = (np.repeat(row[i:j], counts[i:j]) * n_items + item) * cells + diagonal // (self.edits[item] + 1)
            k, n = np.unique(cell, return_counts=True)
            keys.append(k)
            numbers.append(n)
        if not keys:
            none = np.zeros(0, np.int64)
            return none, none, none
        cell, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        number = np.bincount(inverse, np.concatenate(numbers))
        after = np.searchsorted(cell, cell + 1)
        pair = number + np.where((after < len(cell)) & (cell[np.minimum(after, len(cell) - 1)] == cell + 1),
            number[np.minimum(after, len(cell) - 1)], 0)
        # a band may also begin one cell before the first counted one, but then it holds no more
        item = cell // cells % n_items
        good = pair >= self.needed[item]
        cell, item = cell[good], item[good]
        return cell // cells // n_items, item, cell % cells * (self.edits[item] + 1) - shift

    def matches(self, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """(row, item, distance, place) of the best match of each item in each text, as four arrays."""
        offsets = text_bytes(column)[1]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, j in groups(offsets, 1 << 20):
            text, own = normalized(column.slice(i, j - i))
            row, item, diagonal = self._regions(folded(text), own)
            pairs, begins = [], []
            for r, k, d in zip(row.tolist(), item.tolist(), diagonal.tolist(), strict=True):
                e, size = int(self.edits[k]), int(own[r + 1] - own[r])
                s = max(0, d - e)
                stop = min(size, d + 2 * (e + 1) + int(self.length[k]) + e)
                pairs.append((self.texts[k], text[own[r] + s : own[r] + max(s, stop)].astype(np.int64)))
                begins.append(s)
            limits = self.edits[item]
            distance = contained_distances(pairs, limits)
            ok = np.flatnonzero(distance <= limits)
            best = ok[np.lexsort((np.array(begins, np.int64)[ok], distance[ok], item[ok], row[ok]))]
            first = np.ones(len(best), bool)
            first[1:] = (row[best][1:] != row[best][:-1]) | (item[best][1:] != item[best][:-1])
            best = best[first]
            for to, x in zip(out, (row[best] + i, item[best], distance[best], np.array(begins, np.int64)[best]), strict=True):
                to.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()),
            T.StructField("place", T.LongType())]))
_ARROW_LEAK = pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("place", pa.int64())])


def mark_leaks(docs: DataFrame, index: PassageIndex, text_col: str = "text", to: str = "leaks") -> DataFrame:
    """All columns of ``docs`` (one named ``to`` is replaced) and the items found in each text.

    ``place`` is where the matching region begins in the normalized text.
    """
    rows = docs.drop(to)
    at = rows.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value
            n = batch.num_rows
            if len(found.ids):
                row, item, distance, place = found.matches(batch.column(at).cast(pa.string()))
            else:
                row = item = distance = place = np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            leaks = pa.StructArray.from_arrays([found.ids.take(pa.array(item)), pa.array(distance), pa.array(place)],
                fields=list(_ARROW_LEAK))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), leaks)], [*batch.schema.names, to])

    return rows.transform(map_batches, run, T.StructType([*rows.schema.fields, T.StructField(to, LEAKS)]))


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
    units: int = BLOCK_UNITS) -> Iterator[PassageIndex]:
    """Indexes over the whole benchmark, each over about ``units`` characters of it."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= units:
            yield PassageIndex(block)
            block, size = [], 0
    if block:
        yield PassageIndex(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance long, place long"
    out = docs.sparkSession.createDataFrame([], schema)
    for n, index in enumerate(benchmark_blocks(benchmark)):
        found = mark_leaks(rows, index).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
        out = out.union(found) if n else found
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, with the columns that they had."""
    mark = "leaks"
    while mark in docs.columns:
        mark += "_"
    kept = docs
    for index in benchmark_blocks(benchmark):
        kept = mark_leaks(kept, index, text_col, mark).where(F.size(mark) == 0).drop(mark)
    return kept


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
