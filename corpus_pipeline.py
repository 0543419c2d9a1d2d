"""A training corpus in five stages: language, near copies, benchmark leaks, mixture, token file.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import contamination, language, mixture, near_dups, token_files
from skein.llm.storage import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a lower posterior than this is rejected.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null texts, and texts of no clear language; a missing label is filled in.

    With no labelled text to learn from, no text has a clear language and none is kept.
    """
    trees = language.ContextTrees(language.training_sample(docs))
    named = language.predict_language(docs.select(*COLUMNS), trees)
    clear = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return clear.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id (of equal ids, one row)."""
    classes = near_dups.near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    kept = classes.groupBy("class_node").agg(F.min_by(F.struct("doc_id", "node"), order).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.node").alias("k_node"))
    node = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(*COLUMNS).withColumn("k_own", node)
    same = rows["doc_id"].eqNullSafe(kept["k_id"]) & (rows["k_own"] == kept["k_node"])
    return rows.join(kept, same).dropDuplicates(["doc_id", "k_own"]).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage stands."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.without_leaks(docs.select(*COLUMNS), benchmark)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in shuffled order."""
    return mixture.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of all documents in shuffled order, and where each of them stands in it.

    The columns of documents carry no order, so the file's own is drawn here; copies of a document stand apart.
    """
    return token_files.read_token_file(*token_files.write_token_file(docs, shuffle_seed=mixture.SEED))


STAGES = [
    ("language", keep_known_languages),
    ("near copies", keep_one_of_each_class),
    ("benchmark leaks", drop_benchmark_leaks),
    ("mixture", mix_to_weights),
    ("token file", write_tokens),
]

#: Language trees and alignments have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what the one before it wrote."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, step) in enumerate(STAGES):
        docs = stage.keep(step(spark, docs, sf_dir), f"stage-{number}")
    return docs
