"""A training corpus from ``documents``: rules, line chunks, near copies, mix, packed sequences.

Every stage takes all rows that the one before it kept, as Parquet, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from textloom import scratch
from textloom.llm import line_dedup, mixing, ngram_join, packing, quality_rules


#: Marks in ``scratch`` around the intermediate tables of stages whose results are still to be written, by session, tables and stage.
_pending: dict[tuple[str, str, int], list[tuple[int, int]]] = {}


def stage(function):
    """A stage. Once the next one of the same session and tables is called with its written result, its intermediate tables go.

    They stay where the stage was called more than once before that: nothing shows then which result is meant.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [f for _, f in STAGES].index(run_stage)
        key = (spark.sparkContext.applicationId, sf_dir)
        before = _pending.pop((*key, place - 1), [])
        if len(before) == 1:
            scratch.release_between(*before[0])
        start = scratch.written()
        out = function(spark, docs, sf_dir)
        _pending.setdefault((*key, place), []).append((start, scratch.written()))
        return out

    return run_stage


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; one document of each group stays."""
    return ngram_join.drop_near_copies(docs, n=5, num=80, den=100)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("line dedup", lines), ("near copies", near_copies), ("mix", mix), ("pack", pack)]

#: SQL can't express the packing stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        done = scratch.materialize(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.release(docs)  # the tables of sf_dir are not of this folder and stay
        docs = done
    return docs
