"""Operator 12: the trie of conversation prefixes, with subtree totals by leaf-peeling message passing.

A node is a different sequence of the first d turns (role, text); the root has none. Its
members are the conversations that start with it, and it is named by their least
``conv_id`` and its depth. ``n_leaves`` counts the childless nodes of its subtree (itself
included), ``saved_tokens`` adds up, over its subtree, (members - 1) times the words of a
node's last text: what a cache of prefixes saves.

The sequence of a prefix is hashed to 124 bits, as running sums of a hash of turn and
depth, so a conversation of any length is worked on in as many tasks as it needs and no
text leaves the first step.

Every node is owned by the member whose hashed id is least. The nodes of one owner are a
path that goes down to where the owner ends, and the paths form a tree. Messages pass
between paths: each path holds a counter of the paths that hang off it; those whose
counter is zero are peeled, send the totals of their top's subtree to the node that they
hang from, and lower that path's counter; this goes on until the root's path is done. Along
any way down owners change about as often as a running minimum of random numbers does, so
the number of rounds grows with the logarithm of the number of conversations, however deep
the trie is. What hangs off one node is added up before it is sent on, so a node with very
many children costs no task more than others. Totals within a path are running sums.

Null role or text is empty. Turns are ordered by turn (null first), then role and text;
repeated rows are turns of their own. Rows without a ``conv_id`` belong to no conversation
and to no node. A conversation without turns is a member of the root only. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .running import MASK, running
from .storage import Stage, map_batches

KEY = ["depth", "k1", "k2"]
ABOVE = ["above_depth", "p1", "p2"]
#: Conversations whose ids lie in one range of this length are joined to one string before a node's digest is taken.
IDS = 4096
#: Tasks that the nodes below one parent are dealt out to.
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def placed_turns(rows: DataFrame, stage: Stage) -> DataFrame:
    """(conv_id, at, x, y, words): every turn's place in its conversation, two hashes of its role and text, the words of its text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    said = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    keep = ["conv_id", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    placed = running(said, "conv_id", ["turn", "role", "text"], [], keep, stage, "placed")
    return placed.select("conv_id", "at", F.xxhash64("digest").alias("x"), F.xxhash64("digest", F.lit(1)).alias("y"), "words")


def rebuilt_turns(placed: DataFrame, convs: DataFrame, block: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, depth, x, y, words): the first h turns of the first conversation of a block, then those after a conversation's own first h.

    ``convs`` has conv_id and n, the number of its turns; h is the crc32 of the id modulo ``most`` + 1.
    """
    first = F.pmod("conv_id", F.lit(block)) == 0
    taken = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    of = convs.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("base"),
        taken.alias("h")).where("conv_id <> base AND h > 0")
    heads = placed.where(first & (F.col("at") < most)).withColumnRenamed("conv_id", "base")
    borrowed = of.join(heads, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "x", "y", "words")
    lengths = convs.where(first).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    # where the first conversation is shorter than h, what follows moves up
    short = of.join(lengths, "base", "left").select("conv_id", (F.col("h") - F.coalesce("there", F.lit(0))).alias("less")).where("less > 0")
    short = short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = placed.where(first | (F.col("at") >= taken)).withColumn("salt", F.pmod("at", F.lit(SALTS)).cast("int"))
    moved = own.join(short, ["conv_id", "salt"], "left")
    return moved.select("conv_id", (F.col("at") + 1 - F.coalesce("less", F.lit(0))).alias("depth"), "x", "y", "words").union(borrowed)


def keyed_turns(turns: DataFrame, stage: Stage) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): each turn with the hash of the prefix that it ends and of the one before."""
    mixed = lambda c, i: F.xxhash64(c, F.lit(i), "depth").bitwiseAND(F.lit(MASK)).alias(f"v{i}")
    rows = turns.select("conv_id", "depth", mixed("x", 1), mixed("y", 2), "words")
    summed = running(rows, "conv_id", ["depth"], ["v1", "v2"], ["conv_id", "depth", "v1", "v2", "words"], stage, "turns")
    before = lambda i: (F.col(f"run_v{i}") - F.col(f"v{i}") + F.lit(MASK) + 1).bitwiseAND(F.lit(MASK)).alias(f"p{i}")
    return summed.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("run_v1").alias("k1"), F.col("run_v2").alias("k2"),
        before(1), before(2), "words")


def _owner() -> Column:
    return F.min(F.struct(F.xxhash64("conv_id").alias("rank"), F.col("conv_id").alias("owner")))


def _ended(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(KEY, ends_sha256, end_owner): for each node where conversations end, the digest of their ids and the least ranked of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> tuple:
            return (*now, state.hexdigest())

        for batch in batches:
            out = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append(row())
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row()], [*KEY, "ends_sha256"])

    last = turns.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("e"))
    none = F.lit(0).cast("long")
    ends = convs.select("conv_id").join(last, "conv_id", "left").select("conv_id",
        *(F.coalesce(F.col(f"e.{c}"), none).alias(c) for c in KEY))
    ranges = ends.groupBy(*KEY, F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"),
        _owner().alias("o"))
    told = ranges.select(*KEY, "range", F.array_join("ids", ",").alias("ids"))
    digests = map_batches(told.repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids"), run,
        "depth long, k1 long, k2 long, ends_sha256 string")
    owners = ranges.groupBy(*KEY).agg(F.min("o").alias("o")).select(*KEY, F.col("o.owner").alias("end_owner"))
    return digests.join(owners, KEY)


def _peeled(paths: DataFrame, parents: DataFrame, stage: Stage) -> DataFrame:
    """(ABOVE, leaves, saved): what every path but the root's sends to the node that it hangs from, path by path.

    ``paths`` has owner, ABOVE, leaves, saved and pending, the number of paths that hang off it; ``parents`` has ABOVE and
    parent, the owner of that node.
    """
    waiting, sent, n = paths, None, 0
    while not waiting.isEmpty():
        n += 1
        ready = stage.keep(waiting.where("pending = 0 AND above_depth >= 0").select(*ABOVE, "leaves", "saved"), f"sent-{n}")
        sent = ready if sent is None else sent.union(ready)
        told = ready.groupBy(*ABOVE).agg(F.count("*").alias("more"), F.sum("leaves").alias("more_leaves"),
            F.sum("saved").alias("more_saved"))
        told = told.join(parents, ABOVE).groupBy(F.col("parent").alias("owner"))
        told = told.agg(F.sum("more").alias("more"), F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        left = waiting.where("pending > 0").join(told, "owner", "left")
        plus = lambda a, b, sign=1: (F.col(a) + sign * F.coalesce(F.col(b), F.lit(0))).alias(a)
        waiting = stage.keep(
            left.select("owner", *ABOVE, plus("leaves", "more_leaves"), plus("saved", "more_saved"),
                plus("pending", "more", -1)), f"waiting-{n}"
        )
    return sent


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, from rows (conv_id, turn, role, text)."""
    stage = Stage(rows.sparkSession, "prefix-trie")
    placed = placed_turns(rows, stage)
    convs = stage.keep(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "convs")
    turns = keyed_turns(rebuilt_turns(placed, convs), stage)

    none = F.lit(0).cast("long")
    found = turns.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), _owner().alias("o"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), _owner().alias("o")).where("n_convs > 0")
    top = top.select(none.alias("depth"), none.alias("k1"), none.alias("k2"), "conv_id", "n_convs", "o", none.alias("p1"),
        none.alias("p2"), none.alias("words"))
    nodes = found.unionByName(top).join(_ended(turns, convs), KEY, "left")
    nodes = stage.keep(
        nodes.select(
            *KEY, (F.col("depth") - 1).alias("above_depth"), "p1", "p2", "conv_id", "n_convs", F.col("o.owner").alias("owner"),
                "ends_sha256",
            F.coalesce(F.col("end_owner") == F.col("o.owner"), F.lit(False)).alias("is_end"),
                ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "nodes",
    )

    # one path an owner: its top, what its own nodes save, and whether it ends in a leaf
    paths = nodes.groupBy("owner").agg(F.min(F.struct(*KEY, *ABOVE)).alias("top"), F.sum("saved").alias("saved"))
    paths = stage.keep(paths.select("owner", *(F.col(f"top.{c}").alias(c) for c in (*KEY, *ABOVE)), "saved"), "paths")
    hanging = paths.where("depth > 0").groupBy(*ABOVE).agg(F.count("*").alias("n_hanging"))
    below = nodes.select(*(F.col(k).alias(a) for k, a in zip(KEY, ABOVE, strict=True)), "owner", "conv_id", "is_end")
    parents = stage.keep(hanging.join(below, ABOVE), "parents")
    pending = parents.groupBy("owner").agg(F.sum("n_hanging").alias("pending"), F.max("is_end").alias("goes_on"))
    counted = paths.join(pending, "owner", "left").withColumn("leaves", F.when(F.col("goes_on"), 0).otherwise(1).cast("long"))
    counted = counted.select("owner", *ABOVE, "leaves", "saved", F.coalesce("pending", none).alias("pending"))
    sent = _peeled(stage.keep(counted, "waiting-0"), parents.select(*ABOVE, F.col("owner").alias("parent")), stage)
    if sent is None:
        sent = counted.select(*ABOVE, "leaves", "saved").limit(0)
    sums = sent.groupBy(*ABOVE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"), F.count("*").alias("n_hanging"))
    sums = sums.select(*(F.col(a).alias(k) for a, k in zip(ABOVE, KEY, strict=True)), "leaves", "more", "n_hanging")

    whole = nodes.join(sums, KEY, "left").join(paths.select(*KEY, F.lit(True).alias("is_top")), KEY, "left")
    whole = whole.select(
        *KEY, *ABOVE, "conv_id", "n_convs", "owner", "ends_sha256", F.coalesce("n_hanging", none).alias("n_hanging"),
            F.coalesce("is_top", F.lit(False)).alias("is_top"),
        (F.coalesce("leaves", none) + (F.col("is_end") & F.col("n_hanging").isNull()).cast("long")).alias("leaves"),
            (F.col("saved") + F.coalesce("more", none)).alias("saved"),
    )
    keep = ["owner", "depth", *ABOVE, "conv_id", "n_convs", "ends_sha256", "n_hanging", "is_top", "leaves", "saved"]
    summed = running(whole, "owner", [-F.col("depth")], ["leaves", "saved"], keep, stage, "summed")

    # a node below its own path's node has one parent row; the tops that hang off one node are dealt out by salt
    above = below.select(*ABOVE, F.col("conv_id").alias("parent_conv_id"), F.lit(-1).alias("salt"))
    spread = parents.select(*ABOVE, F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.when(F.col("is_top"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).otherwise(-1)
    named = summed.withColumn("salt", salt).join(above.union(spread), [*ABOVE, "salt"], "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_hanging") + (F.col("at") > 0).cast("long")).alias("n_children"),
        F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
