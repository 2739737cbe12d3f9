"""Which segments stay under a token budget: first fit in order of score. Running sums can't say it, as what doesn't fit is passed over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores are compared at this many decimals, so that engines agree on ties; ties go to the earlier segment.
DECIMALS = 9


def first_fit(items: Column, room: Column) -> Column:
    """Indices taken from a sorted array of ``(rank, seg_idx, tokens)``: each that still fits, in that order. One pass over a context's
    numbers, outside the JVM, as a fold there copies what it has taken at every step."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for indices, tokens, rooms in batches:
            out = []
            for at, n, left in zip(indices, tokens, rooms, strict=True):
                taken = []
                for i, t in zip(at.tolist(), n.tolist(), strict=True):
                    if t <= left:
                        left -= t
                        taken.append(i)
                out.append(taken)
            yield pd.Series(out)

    return run(F.transform(items, lambda x: x["seg_idx"]), F.transform(items, lambda x: x["tokens"]), room)


def _item(score: str) -> Column:
    return F.struct((-F.round(F.col(score), DECIMALS)).alias("rank"), F.col("seg_idx"), F.col("tokens"))


def _rows(per: DataFrame, taken: Column) -> DataFrame:
    return per.select("ctx_id", F.explode(taken).alias("seg_idx"))


def extractive(segments: DataFrame, minimum: float, score: str = "importance_score") -> DataFrame:
    """``ctx_id, seg_idx`` that stay. Preserved segments come first, even over the budget; a budget of 0 keeps none. Needs a ``budget`` column."""
    open_ = ~F.col("is_preserved") & (F.col(score) > minimum)
    per = segments.groupBy("ctx_id", "budget").agg(
        F.coalesce(F.sum(F.when(F.col("is_preserved"), F.col("tokens"))), F.lit(0)).alias("used"),
        F.collect_list(F.when(F.col("is_preserved"), F.col("seg_idx"))).alias("fixed"),
        F.array_sort(F.collect_list(F.when(open_, _item(score)))).alias("items"),
    )
    per = per.where("budget > 0")
    return _rows(per, F.concat("fixed", first_fit(F.col("items"), F.col("budget") - F.col("used"))))


def fit(segments: DataFrame, score: str = "importance0") -> DataFrame:
    """Unflagged segments by score, no minimum."""
    open_ = ~F.col("is_redundant") & ~F.col("is_boilerplate")
    per = segments.groupBy("ctx_id", "budget").agg(F.array_sort(F.collect_list(F.when(open_, _item(score)))).alias("items"))
    return _rows(per, first_fit(F.col("items"), F.col("budget")))


def with_ends(segments: DataFrame, head: int, tail: int, keep_preserved: bool = True, score: str = "importance0") -> DataFrame:
    """Whole segments from the start until ``head`` tokens are reached, from the end likewise, then unflagged ones by score."""
    w = W.partitionBy("ctx_id").orderBy("seg_idx").rowsBetween(W.unboundedPreceding, -1)
    rows = segments.withColumn("__h", F.coalesce(F.sum("tokens").over(w), F.lit(0)) < head)
    back = W.partitionBy("ctx_id").orderBy(F.desc("seg_idx")).rowsBetween(W.unboundedPreceding, -1)
    behind = F.coalesce(F.sum(F.when(F.col("__h"), 0).otherwise(F.col("tokens"))).over(back), F.lit(0))
    fixed = F.col("__h") | (behind < tail)
    if keep_preserved:
        fixed = fixed | F.col("is_preserved")
    rows = rows.withColumn("__f", fixed)
    open_ = ~F.col("__f") & ~F.col("is_redundant") & ~F.col("is_boilerplate")
    per = rows.groupBy("ctx_id", "budget").agg(
        F.sum(F.when(F.col("__f"), F.col("tokens")).otherwise(0)).alias("used"), F.collect_list(F.when(F.col("__f"), F.col("seg_idx"))).alias("fixed"),
        F.array_sort(F.collect_list(F.when(open_, _item(score)))).alias("items"),
    )
    return _rows(per, F.concat("fixed", first_fit(F.col("items"), F.greatest(F.lit(0), F.col("budget") - F.col("used")))))


def verify(segments: DataFrame) -> DataFrame:
    """``ctx_id, used, budget, within``: whether the selected segments keep to the budget; needs ``selected`` and ``budget`` columns."""
    used = F.coalesce(F.sum(F.when(F.col("selected"), F.col("tokens"))), F.lit(0)).cast("bigint")
    return segments.groupBy("ctx_id", "budget").agg(used.alias("used")).select("ctx_id", "used", "budget", (F.col("used") <= F.col("budget")).alias("within"))
