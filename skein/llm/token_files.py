"""Operator 1: frequency-ranked token ids in a byte-aligned variable-length file.

A block holds neighbouring documents. Each id is replaced by its rank among all
ids of the corpus (most frequent first) and stored in one to four bytes; the
lengths of four ids share one control byte, and control bytes and data bytes
are kept in separate streams. Decoding looks each control byte up in a table
of byte masks and scatters the data with one numpy assignment.

The blocks are rows of a Parquet table, so Spark's committer makes them atomic
and any file system that Spark reads can hold them.

Null text is an empty document (only its end id); null ``doc_id`` sorts first;
repeated ``doc_id`` are ordered by a hash of their ids, then the ids; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import SPACE, HashTable, binary_column, binary_rows, gather, groups, span_hashes, spans, text_bytes
from .storage import map_batches, partitions, Stage

END_ID = 2
BLOCK_IDS = 1 << 20
#: Ids of a part of the file, where the session's number of shuffle partitions would make larger ones.
PART_IDS = 64 << 20
#: Words remembered by a worker before it starts afresh; bounds its memory, not its results.
REMEMBERED_WORDS = 1_000_000
#: A column of the ids that, where it is there, orders the file before ``doc_id`` does.
ORDER = "file_order"
#: For each control byte, which of the 16 bytes of four ids are stored.
MASK = (np.arange(4)[None, None, :] <= ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)[:, :, None]).reshape(256, 16)
#: For each control byte, how many bytes its four ids take.
TAKES = MASK.sum(1)
#: Only these separate pieces; every other character stays in its piece for the tokenizer to judge.
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 13]] = True
assert not (_BREAK & ~SPACE).any()
#: Letters that normalization leaves or lower-cases as one letter each, so no mark of theirs can join a stop.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8)
    extra += ranks > 0xFFFF
    extra += ranks > 0xFFFFFF
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    stored = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[stored].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that ``pack`` was given."""
    control_bytes = np.frombuffer(control, np.uint8)
    stored = MASK[control_bytes].reshape(-1)[: 4 * n]
    out = np.zeros(4 * n, np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


def splits_at_blanks(path: str) -> bool:
    """Whether a vocabulary file is one whose ids of a text are those of its pieces between blanks.

    That is known, and tested, for pre-tokens of one script class each, of lower-cased composed text in which any white space is a
    blank, and merges that end at a word's end. Any other file is taken to need whole texts.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    normal = said.get("normalizer") or {}
    steps = [n.get("type") for n in normal.get("normalizers", [])]
    split = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model = said.get("model") or {}
    return (
        steps == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and normal["normalizers"][1].get("content") == " "
        and split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and split.get("behavior")
            == "Removed"
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix")
            and model.get("dropout") is None
        and all(t.get("special") and not any(c.isspace() for c in t["content"]) for t in said.get("added_tokens") or [])
    )


class WholeIds:
    """Token ids of whole texts, encoded whole: for vocabularies whose texts can't be cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows end to end, and the number of ids of each row."""
        data = raw.tobytes()
        texts = [data[s:e].decode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), self.dtype, int(counts.sum())), counts


class WordIds:
    """Token ids of whole texts, each distinct piece between blanks tokenized once.

    White space always ends a pre-token of the vocabulary used here, and so does a Latin
    letter before a final full stop or comma (other letters may be normalized to a letter
    and a mark, which joins the stop); the ids of a text are then those of its pieces, end
    to end. Tests hold this against encoding whole texts, with every letter that there is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.uint32, "I")
        self.ends_word = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.table, self.stems = HashTable(room=1 << 16), {}
        self.pool, self.pooled = np.zeros(1 << 20, self.dtype), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn_stems(self, stems: list[str]) -> None:
        """Remember the ids of each stem as bytes: no object per id, and nothing for the garbage collector to walk."""
        plain = [s for s in stems if _LETTERS.fullmatch(s)]
        rest = [s for s in stems if not _LETTERS.fullmatch(s)]
        sets = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for own, ids in zip(sets, self._ids([" ".join(x) for x in sets]), strict=True):
            packed = self._packed(ids)
            cut = (np.flatnonzero(self.ends_word[np.frombuffer(packed, self.dtype)]) + 1) * self.dtype().itemsize
            if len(cut) == len(own) and cut[-1] == len(packed):
                ends = cut.tolist()
                self.stems.update(zip(own, [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            else:
                rest += own
        self.stems.update(zip(rest, map(self._packed, self._ids(rest)), strict=True))

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        cut = [(p[:-1], p[-1]) if len(p) > 1 and p[-1] in ".," and _LETTERS.fullmatch(p, 0, len(p) - 1) else (p, "") for p in pieces]
        self._learn_stems(list({s for pair in cut for s in pair if s and s not in self.stems}))
        self.stems[""] = b""
        packed = [self.stems[a] + self.stems[b] for a, b in cut]
        length = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype().itemsize
        flat = np.frombuffer(b"".join(packed), self.dtype)
        while self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self.start = np.concatenate([self.start, self.pooled + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pooled += len(flat)
        self.table.add(hashes)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows end to end, and the number of ids of each row."""
        starts, ends, rows = spans(raw, offsets, _BREAK)
        hashes = span_hashes(raw, starts, ends)
        found = self.table.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.table.n + len(new) > REMEMBERED_WORDS and self.table.n:
                self._forget()
                new = np.arange(len(hashes))
            keys, first = np.unique(hashes[new], return_index=True)
            data, at = raw.tobytes(), new[first]
            self._learn(keys, [data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found = self.table.find(hashes)
        length = self.length[found]
        ids = gather(self.pool, self.start[found], length)
        return ids, np.bincount(rows, length, len(offsets) - 1).astype(np.int64)


@lru_cache(1)
def _words(path: str) -> WordIds | WholeIds:
    return WordIds(path) if splits_at_blanks(path) else WholeIds(path)


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is, or the place of a vocabulary file of the public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``ids``, its token ids and the end id as little-endian binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path(tokenizer))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in groups(offsets, 8 << 20):
                part = offsets[i : j + 1]
                ids, counts = words.encode(raw[part[0] : part[-1]], part - part[0])
                closed = np.insert(ids, np.cumsum(counts), words.dtype(END_ID))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), binary_column(closed, counts + 1)], ["doc_id", "ids"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(map_batches, run, "doc_id long, ids binary")


def id_width(tokenizer: str) -> type:
    return _words(tokenizer_path(tokenizer)).dtype


def id_counts(ids: DataFrame, dtype: type) -> DataFrame:
    """How often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            flat, _ = binary_rows(batch.column(0), dtype)
            got = np.bincount(flat)
            if len(got) > len(counts):
                counts, got = got, counts
            counts[: len(got)] += got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    partial = ids.select("ids").transform(map_batches, run, "id long, n long")
    return partial.groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(ids: DataFrame, id_of_rank: np.ndarray, dtype: type, n_parts: int) -> DataFrame:
    """Encoded blocks in ascending ``doc_id`` order: part, block number, first position within the part, rows."""
    rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    schema = "part int, block int, start_in_part long, n_ids long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            flat, counts = binary_rows(batch.column(1), dtype)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            for i, j in groups(offsets, BLOCK_IDS):
                control, data = pack(rank_of_id[flat[offsets[i] : offsets[j]]])
                n = int(offsets[j] - offsets[i])
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, (part, block, start, n, batch.column(0).slice(i, j - i).to_pylist(), counts[i:j].tolist(), control,
                                    data), strict=True))],
                    pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()),
                            ("data", pa.binary())]),
                )
                block, start = block + 1, start + n

    order = [*([ORDER] if ORDER in ids.columns else []), "doc_id", F.xxhash64("ids")]
    ordered = ids.repartitionByRange(n_parts, *order).sortWithinPartitions(*order, "ids").select("doc_id", "ids")
    return ordered.transform(map_batches, run, schema)


def shuffled(ids: DataFrame, seed: int) -> DataFrame:
    """The ids with a file order: a hash of the document and of its number among equal rows."""
    same = Window.partitionBy("doc_id", F.xxhash64("ids")).orderBy(F.lit(0))
    return ids.withColumn(ORDER, F.xxhash64(F.lit(seed), "doc_id", F.row_number().over(same)))


def write_token_file(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text",
    shuffle_seed: int | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Encode all documents; returns the stored blocks, each part's first position, and the ids by rank.

    With ``shuffle_seed`` the file has a shuffled order, otherwise that of ``doc_id``.
    Part totals and the ranking are the only things the driver sees: one row per
    output part and one per vocabulary entry, whatever the corpus size.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "token-file")
    dtype = id_width(tokenizer)
    ids = stage.keep(token_ids(docs, tokenizer, id_col, text_col), "ids")
    counted = id_counts(ids, dtype).orderBy(F.desc("n"), "id").toPandas()
    ranking = counted["id"].to_numpy(np.int64)
    n_parts = max(partitions(spark), int(counted["n"].sum()) // PART_IDS)
    ordered = ids if shuffle_seed is None else shuffled(ids, shuffle_seed)
    blocks = stage.keep(write_blocks(ordered, ranking, dtype, n_parts), "blocks")
    stage.drop("ids")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toPandas()
    starts = (np.cumsum(totals["n"]) - totals["n"]).astype(int)
    bases = spark.createDataFrame([(int(p), int(s)) for p, s in zip(totals["part"], starts, strict=True)], "part int, base long")
    return blocks, bases, ranking


def read_token_file(blocks: DataFrame, bases: DataFrame, id_of_rank: np.ndarray) -> DataFrame:
    """Decode the blocks: one row per document with start, n_tokens and the crc32 of its ids."""
    table = id_of_rank.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n_tokens"], np.int64)
                ids = table[unpack(row["control"], row["data"], row["n_ids"])].view(np.uint8)
                ends = np.cumsum(counts)
                begins = ends - counts
                view = memoryview(ids)
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + begins), pa.array(counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part"))
    return placed.select("n_ids", "doc_ids", "n_tokens", "control", "data", "start").transform(map_batches, 
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the token file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_file(*write_token_file(docs))
