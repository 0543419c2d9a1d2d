"""Operator 5: language-model scores from a log-frequency Bloom filter.

All words and all word pairs of the training texts are counted, down to those that
occur once, at every size alike. Keys are dealt out by hash to parts of about
``PART_BYTES`` of text each, so a part has the same size whatever the corpus, and
their number follows the input. A part holds the exact counts of its words and one
filter with the counts of its pairs: a count is quantised on a log scale (exactly up
to 5), and the filter holds one entry for each level up to it, so a count is found by
probing level after level until one is absent. The upper half of a pair's key names
its part, the lower half stands for it there: of a million pairs one in 4 000 shares
it with another.

The texts to score are packed in chunks of about ``CHUNK_BYTES``, which are written once. A chunk sends the different words and pairs
that it needs to their parts, each part that was asked answers, and the answers meet the chunk's
texts again. A row goes from a chunk to a part only if it carries something, so rows are
never more than the different words and pairs of all chunks, which grow with the input,
however many parts there are. Nothing is collected or broadcast but two totals.

The model is a bigram model with Dirichlet smoothing: a pair's count and ``PRIOR``
times the add-one probability of its second word, over its first word's count and
``PRIOR``. A word after one that was never seen has its add-one probability. As every
word is followed by one (the end at last), the probabilities after a word add up to
those of all words.

Tokens are runs of anything but space and bytes 9 to 13, with A to Z
lower-cased, and one end token per text, known by 64-bit hashes. Null text is
empty: its end token only. With no training text all probabilities are one over
one. Repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, U64, binary_column, binary_rows, groups, mix, span_hashes, spans, text_bytes
from .language import bucket
from .storage import map_batches, Stage

#: Bytes of text (of the larger of both tables) for each part of the model.
PART_BYTES = 16 << 20
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Occurrences of a first word that the add-one probabilities of what follows weigh as much as.
PRIOR = 32.0
#: Levels per doubling of a count.
LEVELS_PER_OCTAVE = 4
#: Probes per entry; the filter has 1.45 times as many bits for each entry.
PROBES = 10
END = U64(0x5EED0E4D0F7E87A1)
PAIR = mix(np.array([2], U64))
#: The least count of each level, from level 1 on: a level holds no number or one at least.
LEVELS = np.unique(np.ceil(np.exp2(np.arange(62 * LEVELS_PER_OCTAVE) / LEVELS_PER_OCTAVE) - 1e-9))
#: The count that stands for each level, 0 for none: the middle of what it holds.
COUNT_OF_LEVEL = np.concatenate([[0.0], np.sqrt(LEVELS * np.append(LEVELS[1:] - 1, LEVELS[-1]))])
#: Kinds of rows of a model.
WORDS, FILTER = 0, 1
#: How counts are written: a byte, or 255 and the rest in another array.
_MANY = 255


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the row of each."""
    raw = LOWER[raw]
    starts, ends, rows = spans(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    n = len(offsets) - 1
    closing = np.cumsum(np.bincount(rows, minlength=n))
    return np.insert(hashes, closing, END), np.insert(rows, closing, np.arange(n))


def pair_keys(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each pair of neighbours, and the place of its second word."""
    at = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    return mix(mix(words[at - 1] + PAIR) + words[at]), at


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and their sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first, dtype=n.dtype) if len(first) else np.zeros(0, n.dtype)


def _parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings keys of one part together, and how many each part has."""
    part = ((keys >> U64(32)) % U64(parts)).astype(np.int32)
    return np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)


def _short(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as a byte each, and the full counts of those that need more."""
    many = counts >= _MANY
    return np.minimum(counts, _MANY).astype(np.uint8), counts[many].astype("<u8")


def _whole(short: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = short.astype(np.int64)
    out[short == _MANY] = more.astype(np.int64)
    return out


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Neighbouring rows with about ``CHUNK_BYTES`` of text (column number ``text``) each, at least one row."""
    held, size = [], 0
    for batch in batches:
        offsets = text_bytes(batch.column(text))[1]
        for i, j in groups(offsets, CHUNK_BYTES):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= CHUNK_BYTES // 2:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def chunk_counts(texts: DataFrame, parts: int) -> DataFrame:
    """The n-grams of each chunk of texts with their counts, a row for each part."""
    names = ["part", "words", "n_words", "more_words", "pairs", "n_pairs", "more_pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 0):
            found, rows = tokens(*text_bytes(table.column(0)))
            columns, needed = [pa.array(np.arange(parts, dtype=np.int32))], np.zeros(parts, bool)
            for keys, dtype in ((found, U64), (pair_keys(found, rows)[0], np.uint32)):
                keys, n = np.unique(keys, return_counts=True)
                order, in_part = _parts(keys, parts)
                short, more = _short(n[order])
                place = np.concatenate([[0], np.cumsum(short == _MANY)])[np.concatenate([[0], np.cumsum(in_part)])]
                columns += [binary_column(keys[order].astype(dtype), in_part), binary_column(short, in_part),
                    binary_column(more, np.diff(place))]
                needed |= in_part > 0
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(needed))

    return texts.select("text").transform(map_batches, run, ", ".join(f"{n} {'int' if n == 'part' else 'binary'}" for n in names))


def packed_chunks(rows: DataFrame, text: int) -> DataFrame:
    """(chunk, packed): the rows in chunks of neighbours, each as one compressed value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, options = TaskContext.get().partitionId() << 33, pa.ipc.IpcWriteOptions(compression="zstd")
        for n, table in enumerate(gathered(batches, text)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["chunk", "packed"])

    return rows.transform(map_batches, run, "chunk long, packed binary")


def _unpacked(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


class LogFrequencyFilter:
    """Quantised counts by repeated membership tests in one bit array."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    @staticmethod
    def start_and_step(keys: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = mix(keys + mix(np.atleast_1d(level).astype(U64)))
        return one, mix(one) | U64(1)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> tuple[LogFrequencyFilter, int]:
        """The filter of these counts, and its number of entries."""
        levels = np.searchsorted(LEVELS, counts, "right")
        total = int(levels.sum())
        bits = max(64, int(total * PROBES / math.log(2)) // 64 * 64 + 64)
        marks = np.zeros(bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            one, two = cls.start_and_step(keys[levels >= level], level)
            for k in range(PROBES):
                marks[((one + U64(k) * two) % U64(bits)).astype(np.int64)] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8").astype(U64, copy=False)), total

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The number of levels present for each key, probed upwards until one is absent."""
        out = np.zeros(len(keys), np.uint8)
        todo, level = np.arange(len(keys)), 0
        while len(todo) and level < len(LEVELS):
            level += 1
            one, two = self.start_and_step(keys[todo], level)
            for k in range(PROBES):
                at = (one + U64(k) * two) % U64(self.bits)
                hit = (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
                if not hit.all():  # a key that fails one probe needs no other
                    todo, one, two = todo[hit], one[hit], two[hit]
            out[todo] = level
        return out


def learned_parts(counted: DataFrame, parts: int) -> DataFrame:
    """Of each part: its words with counts, and its filter.

    ``size`` is the sum of a part's word counts, or the number of entries of its filter.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        get = lambda name, dtype: binary_rows(table.column(name), dtype)[0]
        words, n = _summed(get("words", U64), _whole(get("n_words", np.uint8), get("more_words", np.dtype("<u8"))))
        pairs, n_pairs = _summed(get("pairs", np.uint32), _whole(get("n_pairs", np.uint8), get("more_pairs", np.dtype("<u8"))))
        store, entries = LogFrequencyFilter.of(pairs.astype(U64), n_pairs)
        keys = pa.chunked_array([binary_column(words, [len(words)]), binary_column(store.words, [len(store.words)])])
        values = pa.chunked_array([binary_column(n, [len(n)]), pa.nulls(1, pa.binary())])
        size = np.array([n.sum(), entries], np.int64)
        return pa.table([pa.array([part, part], pa.int32()), pa.array([WORDS, FILTER], pa.int32()), keys, values, pa.array(size)],
            ["part", "kind", "keys", "values", "size"])

    return counted.groupBy("part").applyInArrow(run, "part int, kind int, keys binary, values binary, size long")


def answers(asked: DataFrame, model: DataFrame) -> DataFrame:
    """For rows (chunk, part, words, pairs): the count of each word, and the level of each pair."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        def get(kind, name, dtype):
            return binary_rows(own.filter(pc.equal(own.column("kind"), kind)).column(name), dtype)[0]

        words, n, bits = get(WORDS, "keys", U64), get(WORDS, "values", np.int64), get(FILTER, "keys", U64)
        wanted, in_words = binary_rows(rows.column("words"), U64)
        pairs, in_pairs = binary_rows(rows.column("pairs"), np.uint32)
        counts = np.zeros(len(wanted), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
            hit = words[at] == wanted
            counts[hit] = n[at[hit]]
        levels = LogFrequencyFilter(bits).levels(pairs.astype(U64)) if len(bits) else np.zeros(len(pairs), np.uint8)
        short, more = _short(counts)
        place = np.concatenate([[0], np.cumsum(short == _MANY)])[np.concatenate([[0], np.cumsum(in_words)])]
        columns = [binary_column(short, in_words), binary_column(more, np.diff(place)), binary_column(levels, in_pairs)]
        return pa.table([rows.column("chunk"), rows.column("part"), *columns], ["chunk", "part", "counts", "more_counts", "levels"])

    return model.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run,
        "chunk long, part int, counts binary, more_counts binary, levels binary")


def _aligned(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The answers of all parts, in the order of the keys that were asked for."""
    if len(found) != len(order):
        raise ValueError(f"{len(found)} answers for {len(order)} n-grams")
    out = np.empty_like(found)
    out[order] = found
    return out


def score_chunk(raw: np.ndarray, offsets: np.ndarray, told: pa.Table, parts: int, n: int, v: int) -> tuple[np.ndarray, ...]:
    """Per text: tokens, those that were seen, their base score, and the score."""
    found, rows = tokens(raw, offsets)
    told = told.sort_by("part")
    words, word = np.unique(found, return_inverse=True)
    keys, at = pair_keys(found, rows)
    pairs, pair = np.unique(keys, return_inverse=True)
    by_word, by_pair = _parts(words, parts)[0], _parts(pairs, parts)[0]
    get = lambda name, dtype: binary_rows(told.column(name), dtype)[0]
    counts = _aligned(_whole(get("counts", np.uint8), get("more_counts", np.dtype("<u8"))), by_word).astype(float)
    together = COUNT_OF_LEVEL[_aligned(get("levels", np.uint8), by_pair)][pair]
    one = (counts + 1) / (n + v + 1)
    base = np.log10(one)[word]
    logs = base.copy()
    a, b = word[at - 1], word[at]
    together = np.minimum(together, np.minimum(counts[a], counts[b]))  # also 0 where the filter errs about a word never seen
    shares = (together + PRIOR * one[b]) / (counts[a] + PRIOR)
    seen = counts[a] > 0
    logs[at[seen]] = np.log10(np.minimum(shares[seen], 1.0))
    texts = len(offsets) - 1
    known = np.bincount(rows, counts[word] > 0, texts).astype(np.int64)
    return np.bincount(rows, minlength=texts), known, np.bincount(rows, base, texts), np.bincount(rows, logs, texts)


def learn(train: DataFrame, parts: int, stage: Stage) -> tuple[DataFrame, int, int]:
    """The model of the column text in its parts, the number of tokens and of different words."""
    model = stage.keep(learned_parts(chunk_counts(train, parts), parts), "model")
    total = model.where(F.col("kind") == WORDS).agg(F.sum("size").alias("n"),
        F.sum(F.octet_length("keys") / 8).cast("long").alias("v")).first()
    return model, total["n"] or 0, total["v"] or 0


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """The rows of ``docs`` (any columns, one named text) with n_tokens, n_known, train_tokens, base_score and score.

    ``train`` has a column text. Columns of ``docs`` with the name of a result are replaced.
    """
    stage = Stage(docs.sparkSession, "lm-score")
    text = F.col("text").cast("string").alias("text")
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    parts = max(1, *(-(-x.agg(size).first()[0] // PART_BYTES) for x in (docs, train)))
    model, n, v = learn(train.select(text), parts, stage)

    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = docs.drop(*results)
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, text.alias("text"))
    chunks = stage.keep(packed_chunks(rows, len(others)), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk asks of the parts that it needs."""
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, at = tokens(*text_bytes(_unpacked(packed).column(len(others))))
                words, pairs = np.unique(found), np.unique(pair_keys(found, at)[0])
                (by_word, in_words), (by_pair, in_pairs) = _parts(words, parts), _parts(pairs, parts)
                columns = [binary_column(words[by_word], in_words), binary_column(pairs[by_pair].astype(np.uint32), in_pairs)]
                rows_ = pa.RecordBatch.from_arrays([pa.array(np.full(parts, chunk)), pa.array(np.arange(parts, dtype=np.int32)), *columns],
                    ["chunk", "part", "words", "pairs"])
                yield rows_.filter(pa.array((in_words > 0) | (in_pairs > 0)))

    found = answers(chunks.transform(map_batches, ask, "chunk long, part int, words binary, pairs binary"), model)

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        table = _unpacked(own.column("packed")[0])
        raw, offsets = text_bytes(table.column(len(others)))
        n_tokens, n_known, base, score = score_chunk(raw, offsets, told, parts, n, v)
        columns = [n_tokens, n_known, np.full(table.num_rows, n), base, score]
        return pa.table([*table.columns[: len(others)], *map(pa.array, columns)], [*others, *results])

    types = [T.LongType()] * 3 + [T.DoubleType()] * 2
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    schema = T.StructType([*fields[: len(others)], *map(T.StructField, results, types)])
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under a model of the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (bucket(7) == 2).alias("held_out"))
    return score_texts(docs, docs.where("not held_out"))
