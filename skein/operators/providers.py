"""What an outside provider says about rows: batches, retries, answers that fail open, a memory of earlier answers, summaries of clusters.

The provider is a function of a list of rows (as dicts) that gives a list of answers (dicts with an ``id``) or the text of a
JSON array of them. It may raise ``Unavailable`` to be asked again; what it raises else, or keeps raising, leaves the rows of that batch
without an answer, and rows without an answer stay as they are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap, signal_answer, word_set
from .labels import with_results
from .rollups import cluster_members, grid_clusters

BATCH, LIMIT, TRIES = 50, 1500, 4
ANSWER = "id long, keep boolean, category string, country string, fr string, en string"
Provider = Callable[[list[dict]], list[dict] | str]


class Unavailable(Exception):
    """The provider may answer if it is asked again."""


def array_of(text: str) -> list:
    """The JSON array in an answer's text, with whatever stands around it; empty where there is none."""
    try:
        whole = json.loads(text)
        return whole if isinstance(whole, list) else next((v for v in whole.values() if isinstance(v, list)), []) if isinstance(whole,
            dict) else []
    except ValueError:
        begin, end = text.find("["), text.rfind("]")
        return json.loads(text[begin : end + 1]) if 0 <= begin < end else []


def _answers(ask: Provider, rows: list[dict], tries: int, pause: Callable[[int], float]) -> list[dict]:
    for attempt in range(1, tries + 1):
        try:
            said = ask(rows)
            said = array_of(said) if isinstance(said, str) else said
            known = {str(r["id"]): r["id"] for r in rows}
            return [a | {"id": known[str(a["id"])]} for a in said if isinstance(a, dict) and str(a.get("id")) in known]
        except Unavailable:
            if attempt < tries:
                time.sleep(pause(attempt))
        except Exception:  # an answer that can't be read is none
            return []
    return []


def answers_of(rows: DataFrame, ask: Provider, schema: str = ANSWER, batch: int = BATCH, tries: int = TRIES,
    pause: Callable[[int], float] = lambda n: 2.0**n) -> DataFrame:
    """Answers (``schema``, with id) to the rows, asked ``batch`` at a time within each partition; of several answers to one id the last.

    The rows are dealt out by id, so that a batch holds rows of one partition only and a lost executor's batches are asked again whole.
    """
    fields = schema_fields(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(part: list[dict]) -> pa.RecordBatch:
            last = {a["id"]: a for a in _answers(ask, part, tries, pause)}
            return pa.RecordBatch.from_pydict({f.name: pa.array([_fitting(a.get(f.name), f.type) for a in last.values()], f.type)
                    for f in fields})

        for piece in batches:
            held += piece.to_pylist()
            while len(held) >= batch:
                yield flush(held[:batch])
                held = held[batch:]
        if held:
            yield flush(held)

    return rows.repartition("id").mapInArrow(run, schema)


def schema_fields(rows: DataFrame, schema: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema))


def _fitting(value, kind: pa.DataType):
    """A value of the type, or null for one of another type."""
    try:
        pa.scalar(value, kind)
        return value
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return None


def filtered_by(events: DataFrame, ask: Provider, categories: tuple[str, ...], stage, cached: DataFrame | None = None, limit: int = LIMIT,
    **how) -> tuple[DataFrame, DataFrame]:
    """Events after a provider's answers, and all answers, to be given as ``cached`` the next time.

    Only events without a cached answer are asked for, the best ``limit`` of them. An event that was asked for without result is remembered
    as kept as it is; cached answers of events that are gone are forgotten.
    """
    known = cached.join(events.select("id"), "id", "left_semi") if cached is not None else None
    new = events if known is None else events.join(known.select("id"), "id", "left_anti")
    asked = stage.keep(new.orderBy(F.desc_nulls_last("score"), "id").limit(limit), "asked")
    fresh = stage.keep(answers_of(asked, ask, **how), "answers")
    silent = asked.select("id").join(fresh.select("id"), "id", "left_anti")
    fresh = fresh.unionByName(silent, allowMissingColumns=True)
    every = fresh if known is None else known.unionByName(fresh)
    return with_results(events, every, categories), every


def summaries(events: DataFrame, answers: DataFrame | None = None, size: int = 2, least: int = 3, most: int = 30, best: int = 10,
    points: int = 5) -> DataFrame:
    """One signal of each of the fullest cells: place, country, number of events, summary and key points.

    ``events``: id, title, category, country, score, lat, lon. Without a provider's answers (cell_lat, cell_lon, text) the summary is
    the title among the cell's ``best`` that has the most words in common with the others, and the key points are the best titles.
    With answers a cell whose answer can't be read is left out.
    """
    c = F.col
    cells = grid_clusters(events, size, least, most).select("cell_lat", "cell_lon", c("n").alias("event_count"))
    top = cluster_members(events, cells, best, size).withColumn("words_", word_set(F.coalesce("title", F.lit(""))))
    cell = ["cell_lat", "cell_lon"]
    told = top.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("rank", "title", "category", "country", "words_"))).alias("t"))  # at most ``best`` rows
    country = F.coalesce(c("t")[0]["country"], F.lit(""))
    told = told.join(cells, cell).withColumn("country", country)
    place = F.when(c("country") != "", c("country")).otherwise(
        F.concat(c("cell_lat").cast("string"), F.lit("°, "), c("cell_lon").cast("string"), F.lit("°")))
    id_ = F.concat(F.lit("sig_"), c("cell_lat").cast("string"), F.lit("_"), c("cell_lon").cast("string"))
    own = ["cell_lat", "cell_lon", id_.alias("id"), "country", "event_count"]
    if answers is not None:
        read = told.join(answers.withColumn("a", signal_answer(c("text"))), cell).where("a is not null")
        return read.select(*own, F.coalesce(F.nullif("a.location_name", F.lit("")), "country").alias("location_name"), "a.summary",
            "a.key_points")
    shared = lambda x: F.aggregate("t", F.lit(0.0), lambda s,
        y: s + F.when(y["rank"] != x["rank"], overlap(x["words_"], y["words_"])).otherwise(0.0))
    # rounded, so that sums in another order don't decide between equals
    medoid = F.array_min(F.transform("t", lambda x: F.struct((-F.round(shared(x), 9)).alias("s"), x["rank"].alias("rank"),
                x["title"].alias("title"))))["title"]
    said = F.transform(F.filter(F.slice("t", 1, points), lambda x: F.coalesce(x["title"], F.lit("")) != ""),
        lambda x: F.struct(x["title"].alias("point"), F.lower(F.coalesce(x["category"], F.lit("conflict"))).alias("category")))
    return told.select(*own, place.alias("location_name"), F.coalesce(medoid, F.lit("")).alias("summary"), said.alias("key_points"))
