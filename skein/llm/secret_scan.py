"""Operator 8: secrets in texts by patterns and by a battery of randomness tests.

Three patterns (assignments, access keys, hex runs) give the base spans. Beside
them every unbroken run of key characters is a candidate: its encoding is
inferred (hex, base32, alphanumeric, base64), and under the hypothesis that its
characters are drawn uniformly from that alphabet three tests are made: chi-squared
of the alphabet's classes, runs above and below the median, and serial
correlation. Their p-values are combined by Fisher's method.

Random strings have uniform p-values, words and identifiers have p-values near
zero. How often ordinary text passes as random is measured on decoys: each document
gives one stretch of its text, candidates left out, written in one of the alphabets
and in one of the lengths (a hash of the text chooses), and a small set of joined
common words is added, so that no stratum of encoding and length is without any. The
share of a stratum's decoys that look at least as random as a candidate is its
p-value as ordinary text, one decoy more than seen being counted. Over all different
candidate strings together, each counted once however often it is copied, the step-up
procedure of Benjamini and Hochberg then accepts with a false-discovery rate of
``FDR``. Short strings, where the tests have little power, need a higher randomness by
themselves. Accepted candidates that no base span covers are added with the kind
``random``.

All offsets are code points. Null text is empty. Repeated rows each get a row.
An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import map_batches, Stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE_LENGTH = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}")
KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
P_BINS = 100

# The alphabets of the encodings, narrowest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = tuple((name, frozenset(a), np.array([a.find(chr(i)) for i in range(128)])) for name, a in ALPHABETS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def encoding_of(run: str) -> int:
    """The place in ALPHABETS of the narrowest alphabet that holds the run, -1 if none does."""
    letters = set(run.rstrip("="))
    for i, (_, alphabet, _) in enumerate(_SETS):
        if letters <= alphabet:
            return i
    return -1


def _chi_tail(x: float, dof: int) -> float:
    """Upper tail of chi-squared (Wilson and Hilferty's normal form)."""
    if x <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(run: str, encoding: int) -> float:
    """The combined p-value of a run under uniform draws from its alphabet."""
    _, alphabet, code = _SETS[encoding]
    x = code[np.frombuffer(run.rstrip("=").encode(), np.uint8)]
    n, size = len(x), len(alphabet)
    if n < 8:
        return 0.0
    # classes of characters: digits, the two cases and the rest, vowels apart from consonants, so that each is expected often enough
    classes = _CLASSES[encoding]
    expected = n * np.bincount(classes) / size
    seen = np.bincount(classes[x], minlength=len(expected))
    p = [_chi_tail(float(((seen - expected) ** 2 / expected).sum()), max(1, len(expected) - 1))]
    # repeats of single characters
    counts = np.bincount(x, minlength=size)
    pairs = float((counts * (counts - 1)).sum() / 2)
    mean = n * (n - 1) / 2 / size
    spread = math.sqrt(mean * (1 - 1 / size))
    p.append(0.5 * math.erfc((pairs - mean - 0.5) / spread / math.sqrt(2)))
    above = x >= size / 2
    up = int(above.sum())
    down = n - up
    if up and down:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * up * down / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p.append(math.erfc(abs(runs - mean) / spread / math.sqrt(2)))
    else:
        p.append(2.0 ** (1 - n))
    centred = x - x.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p.append(math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2)))
    total = -2 * sum(math.log(max(min(v, 1.0), 1e-12)) for v in p)
    return _chi_tail(total, 2 * len(p))


def _class_table(alphabet: str) -> np.ndarray:
    def of(c: str) -> int:
        if c.isdigit():
            return 0
        if c in "aeiou":
            return 1
        if c in "AEIOU":
            return 2
        return 3 if c.islower() else 4 if c.isupper() else 0

    found = [of(c) for c in alphabet]
    return np.unique(found, return_inverse=True)[1]


_CLASSES = tuple(_class_table(a) for _, a in ALPHABETS)


#: The least and the greatest length class that decoys are made for; longer strings are held against the greatest.
CLASSES = (CANDIDATE_LENGTH.bit_length(), 8)


def stratum_of(run: str, encoding: int) -> int:
    """Encoding and length class: lengths double from class to class."""
    return encoding * 16 + min(CLASSES[1], len(run).bit_length())


def p_bin(run: str, encoding: int) -> int:
    return min(P_BINS - 1, int(P_BINS * randomness(run, encoding)))


def _key(run: str) -> int:
    return int.from_bytes(hashlib.blake2b(run.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def written_in(text: str, encoding: int) -> str:
    """Ordinary text in an alphabet: other characters left out, blanks as a sign where the alphabet has one."""
    name = ALPHABETS[encoding][0]
    if name.isupper() or name == "base32":
        text = text.upper()
    elif name == "hex":
        text = text.lower()
    if name.startswith("base64"):
        text = text.replace(" ", "/" if name == "base64" else "_")
    return _OTHERS[encoding].sub("", text)


_OTHERS = tuple(re.compile(f"[^{re.escape(a)}]+") for _, a in ALPHABETS)
#: Characters of text looked at for each character of a decoy.
_WINDOW = 12


def decoy(text: str, gone: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(stratum, p-value bin, hash) of one stretch of the text without the given spans, None where it is too short."""
    rng = random.Random(_key(text))
    encoding, cls = rng.randrange(len(ALPHABETS)), rng.randint(*CLASSES)
    length = rng.randrange(max(CANDIDATE_LENGTH, 1 << cls - 1), 1 << cls)
    begin = rng.randrange(max(1, len(text) - _WINDOW * length))
    end, pieces, at = begin + _WINDOW * length, [], begin
    for s, e in gone:
        if e > at and s < end:
            pieces.append(text[at : max(s, at)])
            at = e
    pieces.append(text[at:end])
    run = written_in(" ".join(pieces), encoding)[:length]
    if len(run) < length:
        return None
    return stratum_of(run, encoding), p_bin(run, encoding), _key(run)


#: Common words that the built-in decoys are joined from, and their number in each stratum.
COMMON = (
    "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we "
    "when your can said there use an each which she do how their if will up other about out many then them these so some her would make "
    "like him into time has look two more write go see number no way could people my than first water been call who oil its now find"
).split()
BUILT_IN = 500


def stratum_decoys(encoding: int, cls: int) -> np.ndarray:
    """How many joined common words of one encoding and length class fall in each p-value bin."""
    rng, counts = random.Random(7 + encoding * 16 + cls), np.zeros(P_BINS, np.int64)
    for _ in range(BUILT_IN):
        length, run = rng.randrange(max(CANDIDATE_LENGTH, 1 << cls - 1), 1 << cls), ""
        while len(run) < length:
            words = [rng.choice(COMMON) for _ in range(length // 2)]
            run = written_in(" ".join(w.title() if rng.random() < 0.2 else w for w in words) + str(rng.randrange(1000)), encoding) + run
        counts[p_bin(run[:length], encoding)] += 1
    return counts


@lru_cache(1)
def _built_in(application: str) -> dict[int, tuple[int, ...]]:
    spark = SparkSession.getActiveSession()
    strata = [(e, c) for e in range(len(ALPHABETS)) for c in range(CLASSES[0], CLASSES[1] + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            counts = [stratum_decoys(*k).tolist() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([e * 16 + c for e, c in keys], pa.int32()), pa.array(counts, pa.list_(pa.int64()))],
                ["stratum", "counts"])

    rows = spark.createDataFrame(strata, "encoding int, cls int").repartition(len(strata), "encoding", "cls")
    return {r.stratum: tuple(r["counts"]) for r in rows.mapInArrow(run, "stratum int, counts array<long>").collect()}


def built_in_decoys(spark: SparkSession) -> dict[int, np.ndarray]:
    """For each stratum how many joined common words fall in each p-value bin: the same always, so told once an application by tasks."""
    return {stratum: np.array(counts, np.int64) for stratum, counts in _built_in(spark.sparkContext.applicationId).items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of their starts as disjoint ones."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, stratum, p-value bin, hash) of the runs that no base span overlaps."""
    out, covered = [], merged([(a, b) for a, _, b in base])
    ends = [b for _, b in covered]
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        i = bisect.bisect_right(ends, s)
        if i < len(covered) and covered[i][0] < e:
            continue
        encoding = encoding_of(m.group())
        if encoding >= 0:
            out.append((s, e, stratum_of(m.group(), encoding), p_bin(m.group(), encoding), _key(m.group())))
    return out


_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("p_bin", pa.int32()), ("key", pa.int64())])
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


_DECOY = pa.struct([("stratum", pa.int32()), ("p_bin", pa.int32()), ("key", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found, decoy): pattern spans, candidates with stratum, p-value bin and hash, and a decoy with these."""

    def dicts(names: tuple, rows: list) -> list:
        return [dict(zip(names, x, strict=True)) for x in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found, decoys = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base.append(base_spans(text))
                found.append(candidates(text, base[-1]))
                gone = sorted([(a, b) for a, _, b in base[-1]] + [x[:2] for x in found[-1]])
                decoys.append(decoy(text, merged(gone)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([dicts(("start", "kind", "end"), row) for row in base], pa.list_(_SPAN)),
                    pa.array([dicts(("start", "end", "stratum", "p_bin", "key"), row) for row in found], pa.list_(_FOUND)),
                    pa.array([x and dict(zip(("stratum", "p_bin", "key"), x, strict=True)) for x in decoys], _DECOY),
                ],
                ["doc_id", "base", "found", "decoy"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(map_batches, 
        run,
        "doc_id long, base array<struct<start int, kind int, `end` int>>, found array<struct<start int, `end` int, stratum int, p_bin int, key long>>, "
        "decoy struct<stratum int, p_bin int, key long>",
    )


def _histogram(strings: DataFrame) -> dict[int, np.ndarray]:
    """Different strings by stratum and p-value bin: at most encodings x lengths x 100 rows, whatever the corpus."""
    out: dict[int, np.ndarray] = {}
    for r in strings.distinct().groupBy("stratum", "p_bin").count().collect():
        out.setdefault(r["stratum"], np.zeros(P_BINS, np.int64))[r["p_bin"]] = r["count"]
    return out


def cuts(candidates: dict[int, np.ndarray], decoys: dict[int, np.ndarray], fdr: float = FDR) -> dict[int, int]:
    """The least accepted p-value bin of each stratum that has one."""
    none = np.zeros(P_BINS, np.int64)
    as_text = {}
    for stratum in candidates:
        over = np.cumsum(decoys.get(stratum, none)[::-1])[::-1]
        as_text[stratum] = (over + 1) / (over[0] + 1)
    total = sum(int(c.sum()) for c in candidates.values())
    cells = sorted((float(as_text[s][b]), int(c[b])) for s, c in candidates.items() for b in np.flatnonzero(c))
    limit, upto = 0.0, 0
    for i, (p, n) in enumerate(cells):
        upto += n
        if (i + 1 == len(cells) or cells[i + 1][0] > p) and p <= fdr * upto / total:
            limit = p
    return {s: int(np.argmax(p <= limit)) for s, p in as_text.items() if (p <= limit).any()}


def found_secrets(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """The scanned rows with ``spans``, base spans and accepted candidates in order."""
    decoys = built_in_decoys(scanned.sparkSession)
    for stratum, counts in _histogram(scanned.where("decoy is not null").select("decoy.stratum", "decoy.p_bin", "decoy.key")).items():
        decoys[stratum] = decoys.get(stratum, 0) + counts
    accepted = F.lit(False)
    found = cuts(_histogram(scanned.select(F.explode("found").alias("f")).select("f.stratum", "f.p_bin", "f.key")), decoys, fdr)

    def ok(x):
        test = accepted
        for stratum, b in sorted(found.items()):
            test = F.when(x["stratum"] == stratum, x["p_bin"] >= b).otherwise(test)
        return test

    added = F.transform(
        F.filter("found", ok), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))
    )
    return scanned.withColumn("spans", F.sort_array(F.concat("base", added)))


def _told(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = found_secrets(Stage(spark, "secrets").keep(scan(docs), "scanned"))
    # a default in the inner lambda would be a second parameter, which Spark fills with the element's place
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return rows.select("doc_id", *count, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
