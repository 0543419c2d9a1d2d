"""Operator 13: a Merkle manifest of a dataset by superblock reduction.

Every row is a leaf: the digest of its fields. The leaves of a source, in order of id, are
reduced ``FANOUT`` at a time until one is left, the source's subroot; the subroots, in order
of source, are reduced likewise to the root. Digests are lower-case hex sha256, of the
concatenated hex digests of a run.

A level at a time would be a shuffle a level. Instead the index of a node in its source,
divided by ``FANOUT`` ** ``LEVELS``, names its superblock, and one ``applyInPandas`` group
collapses ``LEVELS`` levels of a superblock, of at most ``FANOUT`` ** ``LEVELS`` nodes
whatever the source's size. The superblocks' roots are the next round's nodes. On the way
down, the proof of a superblock's root (one row a superblock) is handed to its nodes, which
put their own, lower proof before it.

The index of a leaf comes from rows dealt out by ranges of (source, id), so one source may
hold most rows. Only the last superblock of a source is not full, so a group knows from its
own number and size how many levels it has to collapse: a first superblock with free places
is the only one.

A null field is ``-``; a null source is a source of its own, before all others. Rows of a
source are ordered by id (null first), equal ids by leaf, so repeated rows are leaves of
their own. An empty table gives no rows. Columns other than the manifest's are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .running import running
from .storage import Stage

FANOUT = 16
LEVELS = 2
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(told(c.cast("string")) for c in fields)), 256)


def levels_of(bucket: int, n: int, most: int) -> int:
    """How many of at most ``most`` levels superblock ``bucket`` with ``n`` nodes collapses."""
    if bucket:
        return most
    levels = 0
    while FANOUT**levels < n:
        levels += 1
    return levels


def collapsed(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, the given ones first, the superblock's root last."""
    out = [digests]
    for _ in range(levels):
        nodes = out[-1]
        out.append([_digest(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
    return out


def proof_steps(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For each level the digests before and after node ``at`` (and then its parents) in its run, each end to end."""
    steps = []
    for nodes in tree[:-1]:
        run = at - at % FANOUT
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + FANOUT])))
        at //= FANOUT
    return steps


def folded(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a digest leads to."""
    for before, after in steps:
        digest = _digest((before, digest, after))
    return digest


_PROOF = "array<struct<before string, after string>>"


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, idx, digest) of the superblocks of nodes (tree, idx, digest)."""

    def collapse(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        digests = group.sort_values("idx")["digest"].tolist()
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]],
                "digest": [collapsed(digests, levels_of(key[1], len(digests), levels))[-1][0]]})

    return _blocked(nodes, levels).groupBy("tree", "bucket").applyInPandas(collapse, "tree string, idx long, digest string")


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("idx") / FANOUT**levels))


def _proved(nodes: DataFrame, upper: DataFrame | None, levels: int, finish, schema: str) -> DataFrame:
    """Each superblock of nodes (tree, idx, digest, ...) through ``finish`` (its rows, the steps of each, what ``upper`` says).

    ``upper`` has one row per superblock (tree, idx) with the proof of its root and what else is handed down.
    """
    columns = [c for c in nodes.columns if c not in ("tree", "idx", "digest")]

    def prove(key: tuple, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, told = group.sort_values("idx").reset_index(drop=True), above.iloc[0] if len(above) else None
        tree = collapsed(group["digest"].tolist(), levels_of(key[1], len(group), levels))
        rest = [(s["before"], s["after"]) for s in told["proof"]] if told is not None else []
        return finish(group, [proof_steps(tree, i) + rest for i in range(len(group))], told)

    rows = _blocked(nodes, levels).select("tree", "bucket", "idx", "digest", *columns)
    if upper is None:
        return rows.groupBy("tree", "bucket").applyInPandas(lambda key, group: prove(key, group, group[:0]), schema)
    above = upper.withColumnRenamed("idx", "bucket")
    pairs = rows.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket"))
    return pairs.applyInPandas(lambda key, group, above: prove(key, group, above), schema)


def _with_proof(nodes: DataFrame, upper: DataFrame | None, levels: int) -> DataFrame:
    """(tree, idx, digest, proof, subroot, root) of inner nodes; the last two as handed down."""

    def finish(group: pd.DataFrame, steps: list, told: pd.Series | None) -> pd.DataFrame:
        proofs = [[{"before": a, "after": b} for a, b in s] for s in steps]
        subroot, root = (None, None) if told is None else (told["subroot"], told["root"])
        return pd.DataFrame({"tree": group["tree"], "idx": group["idx"], "digest": group["digest"], "proof": proofs, "subroot": subroot,
                "root": root})

    return _proved(nodes, upper, levels, finish, f"tree string, idx long, digest string, proof {_PROOF}, subroot string, root string")


def _reduced(nodes: DataFrame, levels: int, stage: Stage, name: str) -> list[DataFrame]:
    """The nodes (tree, idx, digest) of every round, the given ones first, one root a tree last."""
    rounds = [nodes]
    while len(rounds) == 1 or not rounds[-1].where("idx > 0").isEmpty():
        rounds.append(stage.keep(_roots(rounds[-1].select("tree", "idx", "digest"), levels), f"{name}-{len(rounds)}"))
    return rounds


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: its id, leaf, subroot, root and the check of its proof.

    ``proof_sha256`` is the digest of all siblings up to the root, ``folded_root`` what the leaf of ``tampered`` (a text in
    place of the row's own, by default the same) leads to with those siblings, ``verified`` whether that is the root.
    """
    stage = Stage(docs.sparkSession, "merkle")
    changed = leaf([F.col(c) for c in FIELDS[:-1]] + [F.col("text") if tampered is None else tampered])
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    leaves = docs.select("doc_id", source.alias("tree"), leaf([F.col(c) for c in FIELDS]).alias("digest"), changed.alias("other"))
    # a leaf that stays as it is need not be told twice
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other"))).withColumn("id",
        F.col("doc_id").cast("string"))
    leaves = stage.keep(leaves, "leaves")  # texts are read and hashed once; what is dealt out are digests
    placed = running(leaves, "tree", ["doc_id", "digest"], [], ["tree", "id", "digest", "other"], stage, "placed").withColumnRenamed("at",
        "idx")

    rounds = _reduced(placed, levels, stage, "sources")
    subroots = rounds[-1].select(F.lit("all").alias("all"), F.col("tree").alias("source"), "digest")
    ordered = running(subroots, "all", ["source"], [], ["all", "source", "digest"], stage, "subroots")
    tops = stage.keep(ordered.select(F.col("all").alias("tree"), F.col("at").alias("idx"), "digest", "source"), "tops")
    above = _reduced(tops.select("tree", "idx", "digest"), levels, stage, "root")

    upper = None
    for i in range(len(above) - 2, -1, -1):
        upper = stage.keep(_with_proof(above[i], upper, levels), f"root-proofs-{i}")
    root = F.broadcast(above[-1].select(F.col("digest").alias("root")))  # one row
    upper = tops.join(upper.select("tree", "idx", "proof"), ["tree", "idx"]).join(root)
    upper = upper.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"),
        "root")
    upper = stage.keep(upper, "proofs-subroots")
    for i in range(len(rounds) - 2, 0, -1):
        proofs = _with_proof(rounds[i], upper, levels)
        upper = stage.keep(proofs.select("tree", "idx", "proof", "subroot", "root"), f"proofs-{i}")

    def finish(group: pd.DataFrame, steps: list, told: pd.Series) -> pd.DataFrame:
        other = group["other"].where(group["other"].notna(), group["digest"])
        return pd.DataFrame(
            {
                "doc_id": group["id"],
                "leaf": group["digest"],
                "subroot": told["subroot"],
                "root": told["root"],
                "proof_sha256": [_digest(part for step in s for part in step) for s in steps],
                "folded_root": [folded(d, s) for d, s in zip(other, steps, strict=True)],
            }
        )

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    checked = _proved(placed, upper, levels, finish, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
    return checked.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; a fifth of them checked with lower-cased text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(docs, F.when(hit, low).otherwise(F.col("text")))
