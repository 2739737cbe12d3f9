"""Statistics of a compression, for each context and rolled up, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import fixed, less

COUNTS = ("original_tokens", "compressed_tokens", "redundancy_removed", "boilerplate_removed", "extractive_removed", "segments_kept", "segments_total")


def derive(stats: DataFrame) -> DataFrame:
    """Adds ``tokens_saved`` and ``compression_ratio`` (1 if there was nothing)."""
    saved = less(F.col("original_tokens"), F.col("compressed_tokens"))
    ratio = F.when(F.col("original_tokens") == 0, F.lit(1.0)).otherwise(F.col("compressed_tokens") / F.col("original_tokens").cast("double"))
    return stats.withColumn("tokens_saved", saved).withColumn("compression_ratio", ratio)


def extractive_removed(original: Column, redundancy: Column, boilerplate: Column, compressed: Column) -> Column:
    return less(less(less(original, redundancy), boilerplate), compressed)


def rollup(stats: DataFrame, *by: str) -> DataFrame:
    """Sums of all counts over ``by`` and its prefixes, with the number of contexts and the ratio of the sums."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    return derive(stats.rollup(*by).agg(F.count("*").alias("contexts"), *sums))


def report(stats: DataFrame) -> DataFrame:
    """``ctx_id, report``: the statistics as a text of fixed layout."""
    layout = (
        "Compression Statistics\n======================\n\nOriginal tokens:    %8d\nCompressed tokens:  %8d\nTokens saved:       %8d\nCompression ratio:  %7s%%\n\nBreakdown:\n"
        "  Redundancy removed: %6d\n  Boilerplate removed:%6d\n  Extractive removed: %6d\n\nSegments: %d/%d kept\n"
    )
    cols = ("original_tokens", "compressed_tokens", "tokens_saved", fixed(F.col("compression_ratio") * 100.0, 1), "redundancy_removed", "boilerplate_removed", "extractive_removed", "segments_kept", "segments_total")
    return stats.select("ctx_id", F.format_string(layout, *cols).alias("report"))


def json(stats: DataFrame) -> DataFrame:
    """``ctx_id, json``: the statistics as one line, the ratio with four decimals."""
    names = ("original_tokens", "compressed_tokens", "tokens_saved", "compression_ratio", "redundancy_removed", "boilerplate_removed", "extractive_removed", "segments_kept", "segments_total")
    layout = "{" + ",".join(f'"{n}":{"%s" if n == "compression_ratio" else "%d"}' for n in names) + "}"
    cols = (fixed(F.col(n), 4) if n == "compression_ratio" else n for n in names)
    return stats.select("ctx_id", F.format_string(layout, *cols).alias("json"))
