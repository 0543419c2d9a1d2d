"""Operator 11: SimHash near duplicates, compared bit-sliced.

The fingerprint of a text has 64 bits, each set if it is set in over half of the XXH64
values (seed 42) of its 3-word shingles, repeats included. Words are runs of bytes other
than ASCII white space, A to Z lower-cased. A text of one or two words is one shingle, one
without words has the fingerprint zero. Null text counts as empty. Fingerprints at
``RADIUS`` or fewer differing bits are linked, classes are connected components, and
``component_id`` is the least ``doc_id`` of a class (null only if all are null).

Equal fingerprints are one node from the start. Two fingerprints within the radius agree
wholly in one of ``RADIUS + 1`` blocks of their bits, so they meet in the bucket of that
block's value. A bucket of more than ``MOST`` fingerprints is split by the blocks of its
other bits, by the same reasoning, ``DEPTH`` times over; what is still larger is compared
tile by tile, each pair of tiles in a task of its own. So every link is found at every size.

Members of buckets are compared as bit planes: plane b holds bit b of many fingerprints
side by side in machine words, two counter planes and an overflow plane take the differing
bits of all of them at a time by carry-save addition, and a block of comparisons is given
up as soon as all its overflow bits are set. A task gives a spanning forest of the links
that it finds, not the links, so a dense group costs as many rows as it has members.

Repeated rows each get their row; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .kernels import U64
from .storage import Stage, map_batches

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a bucket that are compared in one go.
MOST = 4096
#: How often a bucket that is larger is split by the blocks of the bits that its key leaves open.
DEPTH = 3
#: Shingles that are counted at a time.
_CHUNK = 1 << 16
#: Members that are compared together at least, whatever their buckets: what is found within the radius is a link anyway.
_TILE = 256
#: Planes after which comparisons that are all over the radius are given up.
_EVERY = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The SimHash of one text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(spans), _CHUNK):
        hashes = np.array([digest(flat[b:e], SEED) for b, e in spans[i : i + _CHUNK]], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print): the fingerprint of each text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, print long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row b holds bit b of every fingerprint, as many 64-bit words as needed."""
    n = len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints, ">u8").view(np.uint8).reshape(n, 8), axis=1).T
    padded = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1).view(U64)


def within_radius(asked: np.ndarray, planes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i of ``asked``, j of the ``n`` fingerprints in ``planes``) of all pairs with at most 3 differing bits."""
    bits = np.unpackbits(np.ascontiguousarray(asked, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    alive = np.arange(len(asked))
    flips = np.where(bits.T.astype(bool), U64(0xFFFFFFFFFFFFFFFF), U64(0))
    shape = (len(asked), planes.shape[1])
    ones, twos, over = np.zeros(shape, U64), np.zeros(shape, U64), np.zeros(shape, U64)
    full = U64(0xFFFFFFFFFFFFFFFF)
    for b in range(BITS):
        differ = planes[b][None, :] ^ flips[b, alive][:, None]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if b % _EVERY == _EVERY - 1:
            going = (over != full).any(axis=1)
            if not going.all():
                if not going.any():
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
                alive, ones, twos, over = alive[going], ones[going], twos[going], over[going]
    near = np.unpackbits((~over).view(np.uint8), axis=1)[:, :n]
    i, j = np.nonzero(near)
    return alive[i], j


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its class) after the links (i, j)."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _forest(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left`` or, where given, between ``left`` and ``right``."""
    every = left if right is None else np.concatenate([left, right])
    target = left if right is None else right
    label, planes, skip = np.arange(len(every)), bit_planes(target), 0 if right is None else len(left)
    for s in range(0, len(left), _TILE):
        i, j = within_radius(left[s : s + _TILE], planes, len(target))
        label = _joined(label, i + s, j + skip)
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _compared(members: DataFrame, alone: bool = False) -> DataFrame:
    """Links (a, b) within buckets of members (bucket, tile, print): tile 0 against itself, or, if there is a tile 1, 0 against 1.

    Small buckets are compared together unless ``alone``; only then may there be a tile 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(tiles: list, prints: list) -> pa.RecordBatch:
            tile, prints = np.concatenate(tiles), np.concatenate(prints).view(U64)
            two = tile == 1
            a, b = _forest(prints[~two], prints[two]) if two.any() else _forest(prints)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: tuple[list, list] = ([], [])  # whole buckets that still wait, and the one that may go on
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            tile, prints = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if size and key[s] != last and (size >= _TILE or alone):
                    yield links(*held)
                    held, size = ([], []), 0
                held[0].append(tile[s:e])
                held[1].append(prints[s:e])
                size, last = size + e - s, key[e - 1]
        if size:
            yield links(*held)

    dealt = members.repartition("bucket").sortWithinPartitions("bucket", "tile").select("bucket", "tile", "print")
    return map_batches(dealt, run, "a long, b long")


def _blocks(open_bits: list[int]) -> list[list[int]]:
    """The open bits in RADIUS + 1 blocks of about one size."""
    return [part.tolist() for part in np.array_split(np.array(open_bits), RADIUS + 1)]


def _bucketed(members: DataFrame, depth: int) -> DataFrame:
    """(bucket, path, print) one level deeper; ``path`` numbers the blocks that a bucket's key has taken so far.

    Every print stands in one bucket for each block of the bits that its path leaves open.
    """
    paths: list[tuple[int, list[int]]] = [(0, list(range(BITS)))]
    for _ in range(depth):
        paths = [(p * (RADIUS + 1) + i, [b for b in rest if b not in block]) for p, rest in paths for i, block in enumerate(_blocks(rest))]
    choices = []
    for path, rest in paths:
        for i, block in enumerate(_blocks(rest)):
            mask = sum(1 << b for b in block)
            mask -= (1 << 64) if mask >= 1 << 63 else 0
            choices.append((path, path * (RADIUS + 1) + i, mask))
    taken = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("path"), F.lit(m).cast("long").alias("mask")) for a, b, m in choices))
    mine = F.filter(taken, lambda c: c["from"] == F.col("path"))
    rows = members.select("bucket", "print", F.explode(mine).alias("c"))
    key = F.xxhash64("bucket", "c.path", F.col("print").bitwiseAND(F.col("c.mask")))
    return rows.select(key.alias("bucket"), F.col("c.path").alias("path"), "print")


def links_within(prints: DataFrame, stage: Stage) -> DataFrame:
    """Links (a, b) that join all pairs of the different fingerprints in ``print`` within the radius."""
    members = prints.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("path"), "print")
    found = []
    for depth in range(DEPTH):
        members = stage.keep(_bucketed(members, depth), f"members-{depth}")
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        sized = stage.keep(members.join(sizes, "bucket"), f"sized-{depth}")
        few = sized.where(F.col("n") <= MOST)
        found.append(stage.keep(_compared(few.select("bucket", F.lit(0).alias("tile"), "print")), f"links-{depth}"))
        members = sized.where(F.col("n") > MOST)
        if members.isEmpty():
            break
    else:
        tiles = F.ceil(F.col("n") / MOST).cast("int")
        cut = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
        other = F.sequence(F.lit(0), F.col("tiles") - 1)
        pairs = cut.select("bucket", "print", "tile", F.explode(other).alias("other"))
        first, second = F.least("tile", "other"), F.greatest("tile", "other")
        rows = pairs.select(F.xxhash64("bucket", first, second).alias("bucket"),
            (F.col("tile") > F.col("other")).cast("int").alias("tile"), "print")
        found.append(stage.keep(_compared(rows, alone=True), "links-tiles"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    stage = Stage(docs.sparkSession, "simhash")
    printed = stage.keep(fingerprints(docs, id_col, text_col), "prints")
    different = stage.keep(printed.groupBy("print").agg(F.min("doc_id").alias("least")), "different")
    roots = components(links_within(different, stage), stage, "classes")
    classed = different.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    names = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage.keep(classed.join(names, "root").select("print", "component_id"), "named")
    # a print that a third of the documents have is one row here, and its documents' side of the join is split at run time
    rows = printed.join(named, "print")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the class of its near copies."""
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
