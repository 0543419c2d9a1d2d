"""Operator 2: language identification by prediction by partial matching.

For every language a variable-order context tree over UTF-8 bytes is counted
once on a bounded sample and then frozen. A byte costs -log2 of its share among
the symbols seen in the longest known context; a symbol new to a context first
pays that context's escape (PPM method C, without exclusions), and a byte never
seen costs eight bits. The language whose trees give the shortest code for the
whole text wins. ``score`` is its posterior under equal priors for ``SCORED_BYTES`` bytes
of the text at its average code lengths (for all of a shorter text): the posterior of a
whole text says no more than that it is long.

The costs of all (context, symbol) pairs seen in any language are tabulated for
all languages side by side, so each byte of a text needs about one table probe.

Null text, or text without a letter, is ``und`` with score 0; so is every text
when there is nothing to learn from. Ties go to the first label in order. Rows
with null ``lang`` or null ``text`` aren't learned from. A column of the input
that has the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, HashTable, groups, text_bytes
from .storage import map_batches

ORDER = 4
#: The sample that is learned from: texts per language, their longest length, and labels.
TEXTS_PER_LANGUAGE = 400
LONGEST_TEXT = 20_000
MOST_LANGUAGES = 200
#: Characters that the whole sample is kept to: an even share for each language.
LONGEST_SAMPLE = 8_000_000
#: Characters times labels that the sample is also kept to, which bounds the tables: contexts times labels.
MOST_CELLS = 100_000_000
#: Bytes whose posterior is the score.
SCORED_BYTES = 16
#: What may be a letter; it also matches numerals such as one half, which aren't.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def _windows(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first ``order``: it and the bytes before it as one number, itself lowest."""
    out = np.zeros(len(data) - order, U64)
    for back in range(order, -1, -1):
        out <<= U64(8)
        out |= data[order - back : len(data) - back]
    return out


def _laid_out(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``order`` zero bytes before each, and the places of their own bytes."""
    n = len(offsets) - 1
    at = np.arange(len(raw)) + order * (1 + np.repeat(np.arange(n), np.diff(offsets)))
    out = np.zeros(len(raw) + order * n, np.uint8)
    out[at] = raw
    return out, at


class ContextTrees:
    """Frozen code lengths of byte contexts up to ``order``, a column for each language."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.order = order
        self.languages = sorted(x for x in samples if samples[x])
        n = len(self.languages)
        if not n:
            return
        windows = []
        for name in self.languages:
            raw, offsets = text_bytes(pa.array(samples[name], pa.string()))
            data, at = _laid_out(raw, offsets, order)
            windows.append(_windows(data, order)[at - order])
        self.symbol_tables, self.symbol_costs, self.escape_tables, self.escapes = {}, {}, {}, {}
        below = np.full((1, n), 8.0)
        for k in range(order + 1):
            mask = U64((1 << 8 * (k + 1)) - 1)
            counted = [np.unique(w & mask, return_counts=True) for w in windows]
            keys = np.unique(np.concatenate([c[0] for c in counted]))
            if k < 2:  # every pair of the two lowest orders has an entry
                keys = np.arange(1 << 8 * (k + 1), dtype=U64)
            seen = np.zeros((len(keys), n))
            for column, (own, counts) in enumerate(counted):
                seen[np.searchsorted(keys, own), column] = counts
            contexts, first = np.unique(keys >> U64(8), return_index=True)
            of = np.searchsorted(contexts, keys >> U64(8))
            total = np.add.reduceat(seen, first, axis=0)
            distinct = np.add.reduceat((seen > 0).astype(float), first, axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                own = -np.log2(seen / (total + distinct)[of])
            if k == 0:
                lower = np.broadcast_to(below, seen.shape)
            elif k <= 2:
                lower = below[(keys & U64((1 << 8 * k) - 1)).astype(np.int64)]
            else:
                lower = below[self.symbol_tables[k - 1].find(keys & U64((1 << 8 * k) - 1))]
            below = np.where(seen > 0, own, escape[of] + lower)
            if k >= 1:
                self.symbol_costs[k] = below.astype(np.float32)
            if k >= 2:
                self.symbol_tables[k] = HashTable(keys)
                self.escape_tables[k] = HashTable(contexts)
                self.escapes[k] = escape.astype(np.float32)

    def _costs(self, windows: np.ndarray) -> np.ndarray:
        """Code length in bits of each window's last byte, a column for each language."""
        k = self.order
        found = self.symbol_tables[k].find(windows) if k >= 2 else (windows & U64(0xFFFF)).astype(np.int64)
        out = self.symbol_costs[k][found]
        todo = np.flatnonzero(found < 0)
        out[todo] = 0
        while len(todo):
            left = windows[todo] & U64((1 << 8 * (k + 1)) - 1)
            context = self.escape_tables[k].find(left >> U64(8))
            known = context >= 0
            out[todo[known]] += self.escapes[k][context[known]]
            k -= 1
            left &= U64((1 << 8 * (k + 1)) - 1)
            found = self.symbol_tables[k].find(left) if k >= 2 else left.astype(np.int64)
            hit = found >= 0
            out[todo[hit]] += self.symbol_costs[k][found[hit]]
            todo = todo[~hit]
        return out

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> np.ndarray:
        """Bits of each text in each language."""
        bits = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in groups(offsets, most):
            part = offsets[i : j + 1]
            data, at = _laid_out(raw[part[0] : part[-1]], part - part[0], self.order)
            rows = np.repeat(np.arange(i, j), np.diff(part))
            for s in range(0, len(at), most):  # a single text may be longer than a group
                own = at[s : s + most]
                first = int(own[0]) - self.order
                windows = _windows(data[first : int(own[-1]) + 1], self.order)[own - self.order - first]
                costs, row = self._costs(windows), rows[s : s + most]
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                bits[row[begin]] += np.add.reduceat(costs, begin, axis=0, dtype=np.float64)
        return bits

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The label and its posterior for each text."""
        texts = column.to_pylist()
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        raw, offsets = text_bytes(column)
        bits = self.code_lengths(raw, offsets)
        best = bits.argmin(1)
        share = np.minimum(1.0, SCORED_BYTES / np.maximum(np.diff(offsets), 1))[:, None]
        with np.errstate(under="ignore"):
            score = 1 / np.exp2((bits.min(1, keepdims=True) - bits) * share).sum(1)
        known = np.array([has_letter(t) for t in texts], bool)
        labels = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return labels, np.where(known, score, 0.0)


def training_sample(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = TEXTS_PER_LANGUAGE,
    longest: int = LONGEST_TEXT,
    languages: int = MOST_LANGUAGES,
    characters: int = LONGEST_SAMPLE,
) -> dict[str, list[str]]:
    """Distinct whole texts of each label, chosen by a hash of the text.

    At most ``languages`` labels (the most frequent), ``per_language`` texts of at most
    ``longest`` characters each, and ``characters`` characters in all, of which each label
    has an even share, fewer where ``MOST_CELLS`` needs it: a bound on what the driver and the
    broadcast model hold. A label of which every text is longer, or past the last, isn't learned.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    labelled = docs.select(lang.alias("lang"), text.alias("text")).where(
        F.col("lang").isNotNull() & F.length("text").between(1, longest)
    )
    texts = F.approx_count_distinct(F.xxhash64("text")).alias("texts")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), texts).orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return {}
    characters = min(characters, MOST_CELLS // len(counts))
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, 4.0 * per_language / max(1, r["texts"]))) for r in counts], "lang string, share double"
    )
    by_hash = Window.partitionBy("lang").orderBy("h")
    picked = (
        labelled.withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(shares), "lang")
        .where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
        .withColumn("i", F.row_number().over(by_hash))
        .where(F.col("i") <= per_language)
        .withColumn("upto", F.sum(F.length("text")).over(by_hash))
        .where((F.col("upto") <= characters // len(counts)) | (F.col("i") == 1))
    )
    out: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "i").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict_language(docs: DataFrame, trees: ContextTrees, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``."""
    rows = docs.drop("lang_pred", "score")
    at = rows.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, score = model.value.predict(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.transform(map_batches, run, schema)


def bucket(modulus: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = ContextTrees(training_sample(docs.where(bucket(3) != 1)))
    rows = docs.select("doc_id", (bucket(3) == 1).alias("held_out"), "text")
    return predict_language(rows, trees).select("doc_id", "held_out", "lang_pred", "score")
