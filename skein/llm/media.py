"""Operator 6: TIFF files to one row per page.

Image directories are walked from the header; strips and tiles are decoded
(none, PackBits, LZW, deflate), predictors undone (horizontal for 8, 16 and 32
bits, floating point), and every page becomes a row with its size, sample
layout and pixels in row order. Colour planes stored apart are put together.

Null media gives no page; media that isn't a readable TIFF gives, after the pages
that could be read, one row with page -1 and the reason in ``error`` and no pixels,
and other media are not affected. The digests of such a file are null, with the
reason beside them. A directory chain that runs in a circle ends at its first
repetition.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import map_batches, Stage

# Fixed values of the TIFF 6.0 format: tag numbers, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

PAGE_WIDTH = 576
PAGE_ROWS = 64
#: Largest size of one decoded page in bytes; a page that states more is an error, not a crash.
LARGEST_PAGE = 1 << 30


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as runs, all else as literals."""
    out, i, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush()
            out += bytes((257 - (j - i), data[i]))
        else:
            literal += data[i:j]
        i = j
    flush()
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        # the writer widens its codes one entry early
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The codes that ``unpack_lzw`` reads; the table is cleared before it is full."""
    codes, table, width, last = [(256, 9)], {bytes((i,)): i for i in range(256)}, 9, b""
    for byte in data:
        now = last + bytes((byte,))
        if now in table:
            last = now
            continue
        codes.append((table[last], width))
        table[now] = len(table) + 2
        size = len(table) + 2
        if size >= 4094:
            codes.append((256, width))
            table, width = {bytes((i,)): i for i in range(256)}, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        last = now[-1:]
    if last:
        codes.append((table[last], width))
    codes.append((257, width))
    out, bits, held = bytearray(), 0, 0
    for code, width in codes:
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def _decoded(data: bytes, scheme: int, size: int) -> np.ndarray:
    if scheme == NONE:
        out = data
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = unpack_bits(data, size)
    elif scheme == LZW:
        out = unpack_lzw(data, size)
    else:
        raise ValueError(f"compression {scheme}")
    if len(out) < size:
        raise ValueError("image data ends early")
    return np.frombuffer(out, np.uint8, size)


def _unpredicted(block: np.ndarray, kind: int, rows: int, width: int, samples: int, bits: int, order: str) -> np.ndarray:
    if kind == 1:
        return block
    if kind == 2 and bits in (8, 16, 32):
        values = block.view(f"{order}u{bits // 8}").reshape(rows, width, samples)
        return np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("=")).astype(values.dtype).view(np.uint8).reshape(-1)
    if kind == 3 and bits in (16, 32, 64):
        planes = np.cumsum(block.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, width * samples)
        planes = planes if order == ">" else planes[:, ::-1]
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(-1)
    raise ValueError(f"predictor {kind} of {bits} bits")


def _directory(media: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", media, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
        size = FIELD_SIZE.get(kind, 0) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", media, where)
        if kind in FIELD_CODE and where + size <= len(media):
            tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", media, where)
    (after,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)
    return tags, after


def _page(media: bytes, tags: dict[int, tuple], order: str) -> dict:
    def one(tag: int, otherwise: int | None = None) -> int:
        if tag in tags and tags[tag]:
            return tags[tag][0]
        if otherwise is None:
            raise ValueError(f"tag {tag} is missing")
        return otherwise

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if samples < 1:
        raise ValueError("no samples")
    planes = samples if one(PLANAR, 1) == 2 else 1
    together = samples // planes
    tiled = TILE_AT in tags
    bw = one(TILE_WIDTH) if tiled else width
    bh = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    line = (width * together * bits + 7) // 8
    if bits < 8 and tiled or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample")
    if not 0 < planes * line * height <= LARGEST_PAGE or bw <= 0 or bh <= 0 or bw * bh * together * bits // 8 > LARGEST_PAGE:
        raise ValueError("image size")
    at, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    across, down = -(-width // bw), -(-height // bh)
    if len(at) < across * down * planes or len(sizes) < across * down * planes:
        raise ValueError("too few strips or tiles")
    pixels = np.zeros((planes, height, line), np.uint8)
    unit = (bw * together * bits + 7) // 8
    step = unit if tiled else line
    for k in range(across * down * planes):
        plane, y, x = k // (across * down), k // across % down * bh, k % across
        rows = bh if tiled else min(bh, height - y)
        block = _decoded(media[at[k] : at[k] + sizes[k]], one(COMPRESSION, 1), rows * unit)
        block = _unpredicted(block, one(PREDICTOR, 1), rows, bw, together, bits, order).reshape(rows, unit)
        shown, left = min(rows, height - y), x * step
        pixels[plane, y : y + shown, left : left + unit] = block[:shown, : line - left]
    if planes > 1:
        if bits < 8:
            raise ValueError("planes of partial bytes")
        pixels = pixels.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "pixels": pixels.tobytes()}


def pages_of(media: bytes) -> Iterator[dict]:
    """The pages of a TIFF file in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if not order or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, after = _directory(media, at, order)
        yield _page(media, tags, order)
        at = after


def write_tiff(payload: bytes, width: int = PAGE_WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = 16) -> bytes:
    """Whole lines of 8-bit samples as a little-endian TIFF of several pages.

    Pages take turns: deflated strips with the horizontal predictor, deflated tiles
    of 192 x 16, PackBits strips, LZW strips.
    """
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    for page, y in enumerate(range(0, len(samples), page_rows)):
        image = samples[y : y + page_rows]
        kind = page % 4
        if kind == 1:
            padded = np.zeros((-(-len(image) // 16) * 16, width), np.uint8)
            padded[: len(image)] = image
            blocks = [padded[r : r + 16, c : c + 192].tobytes() for r in range(0, len(padded), 16) for c in range(0, width, 192)]
        else:
            if kind == 0:
                image = np.diff(image, axis=1, prepend=np.uint8(0))
            blocks = [image[r : r + strip_rows].tobytes() for r in range(0, len(image), strip_rows)]
        blocks = [pack_bits(b) if kind == 2 else pack_lzw(b) if kind == 3 else zlib.compress(b, 1) for b in blocks]
        starts = []
        for b in blocks:
            starts.append(len(out))
            out += b
        out += b"\0" * (len(out) % 2)
        n = len(blocks)
        lists = []
        for values in (starts, [len(b) for b in blocks]):
            lists.append(values[0] if n == 1 else len(out))
            if n > 1:
                out += struct.pack(f"<{n}I", *values)
        rows = min(page_rows, len(samples) - y)
        entries = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, rows), (BITS, 3, 1, 8),
            (COMPRESSION, 3, 1, (DEFLATE, DEFLATE, PACKBITS, LZW)[kind]), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1)]
        if kind == 1:
            entries += [(TILE_WIDTH, 3, 1, 192), (TILE_HEIGHT, 3, 1, 16), (TILE_AT, 4, n, lists[0]), (TILE_BYTES, 4, n, lists[1])]
        else:
            entries += [(STRIP_AT, 4, n, lists[0]), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_BYTES, 4, n, lists[1]),
                (PREDICTOR, 3, 1, 2 if kind == 0 else 1)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag, field, count, value in sorted(entries):
            out += struct.pack("<HHII", tag, field, count, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGES = "doc_id long, seq long, n_bytes long, media_bytes long, media_sha256 string, page int, width int, height int, samples int, bits int, pixels binary, error string"
_PAGES = pa.schema(
    [("doc_id", pa.int64()), ("seq", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()),
        ("pixels", pa.binary()), ("error", pa.string())]
)
#: Pixels sent on at a time.
_BATCH_BYTES = 8 << 20


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to whole lines, as a TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode()
                    sizes.append(len(data))
                    lines = max(1, -(-len(data) // PAGE_WIDTH))
                    media.append(write_tiff(data.ljust(lines * PAGE_WIDTH, b"\xff")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(map_batches, run, "doc_id long, n_bytes long, media binary")


def tiff_pages(media: DataFrame) -> DataFrame:
    """One row per page of (doc_id, n_bytes, media); ``seq`` numbers the media of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            held, size = [], 0
            for doc_id, n_bytes, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seq += 1
                if file is None:
                    continue
                own = {"doc_id": doc_id, "seq": seq, "n_bytes": n_bytes, "media_bytes": len(file),
                    "media_sha256": hashlib.sha256(file).hexdigest()}
                try:
                    for page, found in enumerate(pages_of(file)):
                        held.append(own | {"page": page, "error": None} | found)
                        size += len(found["pixels"])
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, _PAGES)
                            held, size = [], 0
                except (ValueError, LookupError, ArithmeticError, struct.error, zlib.error) as e:
                    held.append(own | {"page": -1, "error": str(e)})
            if held:
                yield pa.RecordBatch.from_pylist(held, _PAGES)

    return media.select("doc_id", "n_bytes", "media").transform(map_batches, run, PAGES)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int, error string"
_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("n_pages", pa.int32()), ("error", pa.string())]
)


class _Fold:
    """Digests and grey-level statistics of the pages of one file as they pass."""

    def __init__(self, row: dict):
        self.row, self.pages, self.size, self.tail, self.error = row, 0, 0, b"", None
        self.sha, self.levels, self.edges = hashlib.sha256(), np.zeros(256, np.int64), 0

    def add(self, pixels: bytes) -> None:
        self.sha.update(pixels)
        self.size += len(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        grey = np.frombuffer(pixels, np.uint8)
        self.levels += np.bincount(grey, minlength=256)
        self.edges += int((np.abs(np.diff(grey.astype(np.int16))) > 64).sum())
        self.pages += 1

    def done(self) -> dict:
        if self.error is not None:
            return {k: self.row[k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")} | {"n_pages": self.pages,
                "error": self.error}
        level = np.arange(256)
        mean = float((self.levels * level).sum() / max(self.size, 1))
        spread = float(np.sqrt((self.levels * (level - mean) ** 2).sum() / max(self.size, 1)))
        share = self.levels[self.levels > 0] / max(self.size, 1)
        feature = f"pages={self.pages};mean={mean:.4f};sd={spread:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};edges={self.edges}"
        return {k: self.row[k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")} | {
            "payload_bytes": self.size, "payload_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "feature": feature,
                "n_pages": self.pages,
        }


def page_digests(pages: DataFrame) -> DataFrame:
    """One row per file from its pages, which stand together in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: _Fold | None = None
        for batch in batches:
            out = []
            rows = batch.select(["doc_id", "seq", "n_bytes", "media_bytes", "media_sha256", "error"]).to_pylist()
            for row, pixels in zip(rows, batch.column("pixels"), strict=True):
                if fold is None or fold.row["seq"] != row["seq"]:
                    if fold is not None:
                        out.append(fold.done())
                    fold = _Fold(row)
                fold.error = fold.error or row["error"]
                if pixels.is_valid:
                    fold.add(pixels.as_buffer().to_pybytes())
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)
        if fold is not None:
            yield pa.RecordBatch.from_pylist([fold.done()], _DIGESTS)

    return pages.transform(map_batches, run, DIGESTS)


def op6_media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF, read back page by page, with digests and a feature."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = Stage(spark, "media").keep(text_media(docs), "media")
    return page_digests(tiff_pages(media))
