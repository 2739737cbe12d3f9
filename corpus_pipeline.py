"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing. Part of the subpackage ``llm``.

A stage's result is written and read again before the next stage begins; so the first thing that a stage does is to delete
the scratch tables that the stage before it, in the same thread, has left.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import decontaminate, packing, quality_rules, secrets, simhash
from textmill.llm.common import delete, materialize, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left = threading.local()


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clean(spark)
        before = set(written())
        out = f(spark, docs, sf_dir)
        _left.paths = [p for p in written() if p not in before]
        return out

    return run_stage


def _clean(spark: SparkSession) -> None:
    paths = getattr(_left, "paths", [])
    for p in paths:
        if p in written():
            written().remove(p)
    delete(spark, paths)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share template windows with the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


@_stage
def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    # executors' heaps are large by now; the encoder takes less memory, and more time
    return packing.place(packing.pieces(docs, max_pieces=100_000))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit),
]

#: Simhash, learned quality and bin completion are beyond SQL; tests hold the stages against plain versions: exact similarity of all
#: pairs for near copies, exact windows for leaks, gapless packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    _clean(spark)
    return docs
