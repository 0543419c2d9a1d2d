"""Operator 3: mixing sources to target weights by Poisson replication (DataFrame functions only).

A source with n documents and target share p of T documents has the mean
repetition rate T*p/n. Every document draws a uniform number from a hash of its
id and the seed, inverts the Poisson distribution of its source's rate to get
its count of copies, is exploded by it, and all copies are ordered by a second
hash. Documents are drawn independently, so no source is gathered anywhere; the
per-source distributions are a small table that Catalyst joins by its size.

Without explicit targets, shares follow n to the power ``TEMPERATURE`` and T is
the number of documents. With explicit ones, sources that aren't named get none,
and the key None names the null source; where no named source occurs there are no
rows.

Null source is a source of its own; rows with equal or null ids draw equal
numbers (null counts as the text ``null``). An empty table gives no rows. Input
columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Stage

TEMPERATURE = 0.5
SEED = 17
#: The part of a hash used as a uniform number: 13 hex digits, exact in a double.
_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def source_rates(docs: DataFrame, source_col: str = "source", targets: dict[str | None, float] | None = None, total: int | None = None,
    temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate): documents and mean copies of each source."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, share in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(share)).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    all_ = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    n_total = F.col("all_n") if total is None else F.lit(total)
    # one row of totals beside each source
    return counts.join(F.broadcast(all_)).select(
        "source", "n", F.when(F.col("all_weight") > 0, n_total * F.col("weight") / F.nullif("all_weight",
                    F.lit(0.0)) / F.col("n")).otherwise(0.0).alias("rate")
    )


def poisson_tables(rates: DataFrame) -> DataFrame:
    """For each source the distribution function of its rate at 0, 1, 2, ... as an array."""
    steps = rates.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int"))))
    upto = Window.partitionBy("source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    log_rate = F.when(F.col("rate") > 0, F.log("rate")).otherwise(0.0)
    mass = F.when(
        F.col("rate") > 0, F.exp(F.col("k") * log_rate - F.col("rate") - F.col("log_factorial"))
    ).otherwise((F.col("k") == 0).cast("double"))
    summed = steps.withColumn("log_factorial", log_factorial).withColumn("below", F.sum(mass).over(upto))
    arrays = summed.groupBy("source", "rate").agg(F.sort_array(F.collect_list(F.struct("k", "below"))).alias("steps"))
    return arrays.select("source", "rate", F.col("steps.below").alias("below"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    targets: dict[str | None, float] | None = None,
    total: int | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """Copies of the documents in shuffled order: their columns, ``copy`` (from 1) and ``shuffle_key``."""
    stage = Stage(docs.sparkSession, "mixture")
    tables = stage.keep(poisson_tables(source_rates(docs, source_col, targets, total, temperature)), "tables")
    tables = tables.select(F.col("source").alias("mix_source_"), F.col("below").alias("mix_below_"))
    docs = docs.drop("copy", "shuffle_key", "mix_source_", "mix_below_")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    u = uniform(F.lit(str(seed)), key)
    copies = F.size(F.filter("mix_below_", lambda b: b <= u))
    drawn = (
        docs.join(tables, F.col(source_col).eqNullSafe(F.col("mix_source_")))
        .withColumn("mix_below_", copies)
        .where("mix_below_ > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_below_"))))
        .drop("mix_source_", "mix_below_")
    )
    shuffle_key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string")))
    return drawn.withColumn("shuffle_key", shuffle_key).orderBy("shuffle_key", id_col, "copy")


def op3_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents replicated to tempered source weights, in shuffled order."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mixture_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of ``mix_sources`` with default parameters over a table or subquery."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM {documents} GROUP BY source),
rates AS (SELECT source, n, (SELECT sum(n) FROM counts) * weight / (SELECT sum(weight) FROM counts) / n AS rate FROM counts),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates),
logs AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_factorial FROM steps),
tables AS (SELECT source AS s, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS below FROM logs),
arrays AS (SELECT s, list(below ORDER BY k) AS below FROM tables GROUP BY s),
drawn AS (
  SELECT d.*, len(list_filter(below, lambda b: b <= ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {_DIGITS}))::BIGINT / {16**_DIGITS}::DOUBLE)) AS copies
  FROM {documents} d JOIN arrays ON d.source IS NOT DISTINCT FROM arrays.s
),
copied AS (SELECT * EXCLUDE (copies), unnest(range(1, copies + 1))::INTEGER AS copy FROM drawn)
SELECT *, md5('order{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key FROM copied
"""
