"""Near-duplicate segments within a context: shingles, similarity joins, clusters, representatives.

Segments with the same set of shingles are one class from the start, so copies are never paired with each other. Classes
are joined on shingles, not all with all: for Jaccard, a pair at the threshold shares one of the rarest
``n - ceil(t n) + 1`` shingles of either; for MinHash, a pair with so few unequal minima that they can't touch every band
agrees in a whole band. Both find every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions.text import word_list
from textmill.storage import keep

SKETCH, SEED = 128, 42


def shingles(text: Column) -> Column:
    """Word 3-grams in lower case; of two words both and the pair; of one word itself."""
    bound = F.array(word_list(F.lower(text)))

    def grams(w: Column) -> Column:
        n = F.size(w)
        three = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(3))))
        return F.when(n >= 3, three).when(n == 2, F.concat(w, F.array(F.concat_ws(" ", w)))).otherwise(w)

    return F.element_at(F.transform(bound, grams), 1)


def shingle_sets(segments: DataFrame) -> DataFrame:
    """``ctx_id, seg_idx, sh`` (sorted distinct 64-bit hashes) and ``rep``, the first segment with that set."""
    hashes = F.array_sort(F.array_distinct(F.transform(shingles(F.col("text")), lambda s: F.xxhash64(s))))
    rows = segments.select("ctx_id", "seg_idx", hashes.alias("sh"))
    return rows.withColumn("rep", F.min("seg_idx").over(W.partitionBy("ctx_id", "sh")))


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``ctx_id, i, j, similarity`` of class representatives ``i < j`` with exact Jaccard similarity at the threshold or above."""
    reps = sets.where("seg_idx = rep").where(F.size("sh") > 0).select("ctx_id", F.col("rep").alias("k"), "sh", F.size("sh").alias("n"))
    rows = reps.select("ctx_id", "k", "n", F.explode("sh").alias("h"))
    rows = rows.withColumn("df", F.count("*").over(W.partitionBy("ctx_id", "h"))).where("df > 1")
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    # shingles that no other class has are the rarest of all; what the prefix still holds comes after them
    per = rows.groupBy("ctx_id", "k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("l"))
    left = (F.col("n") - need + 1 - (F.col("n") - F.size("l"))).cast("int")
    prefix = per.where(left > 0).select("ctx_id", "k", "n", F.explode(F.slice("l", F.lit(1), left)).alias("e")).select("ctx_id", "k", "n", "e.h")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, (F.col("a.ctx_id") == F.col("b.ctx_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.k") < F.col("b.k")))
    near = near.where((F.col("a.n") >= F.lit(threshold) * F.col("b.n") - 1e-9) & (F.col("b.n") >= F.lit(threshold) * F.col("a.n") - 1e-9))
    near = near.select(F.col("a.ctx_id").alias("ctx_id"), F.col("a.k").alias("i"), F.col("b.k").alias("j")).distinct()
    x = reps.select("ctx_id", F.col("k").alias("i"), F.col("sh").alias("x"), F.col("n").alias("nx"))
    y = reps.select("ctx_id", F.col("k").alias("j"), F.col("sh").alias("y"), F.col("n").alias("ny"))
    both = near.join(x, ["ctx_id", "i"]).join(y, ["ctx_id", "j"]).withColumn("both", F.size(F.array_intersect("x", "y")))
    similarity = F.col("both") / (F.col("nx") + F.col("ny") - F.col("both")).cast("double")
    return both.select("ctx_id", "i", "j", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def signature(sets: Column) -> Column:
    """128 minima over an array of shingle hashes; all equal where there are none."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([minima(np.asarray(s, dtype=np.int64).view(np.uint64)).view(np.int64).tolist() for s in rows])

    return run(sets)


def minima(h: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, (1 << 64) - 1, dtype=np.uint64)
    for lo in range(0, len(h), 4000):
        x = h[lo : lo + 4000, None] * _MUL + _ADD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return least


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal minima."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.lit(float(SKETCH))


def minhash_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Like :func:`jaccard_pairs`, by the share of equal minima. Needs a threshold over 0."""
    least = math.ceil(threshold * SKETCH - 1e-9)
    if least < 1:
        raise ValueError("minhash pairs need a threshold over 0")
    bands = SKETCH - least + 1  # more bands than minima may differ, so one of them is untouched
    edges = [round(k * SKETCH / bands) for k in range(bands + 1)]
    reps = sets.where("seg_idx = rep").select("ctx_id", F.col("rep").alias("k"), signature(F.col("sh")).alias("sig"))
    keys = F.array(*[F.struct(F.lit(n).alias("band"), F.xxhash64(F.slice("sig", lo + 1, hi - lo)).alias("h")) for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    dealt = reps.select("ctx_id", "k", F.explode(keys).alias("e")).select("ctx_id", "k", "e.band", "e.h")
    a, b = dealt.alias("a"), dealt.alias("b")
    same = (F.col("a.ctx_id") == F.col("b.ctx_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.k") < F.col("b.k"))
    near = a.join(b, same).select(F.col("a.ctx_id").alias("ctx_id"), F.col("a.k").alias("i"), F.col("b.k").alias("j")).distinct()
    x = reps.select("ctx_id", F.col("k").alias("i"), F.col("sig").alias("x"))
    y = reps.select("ctx_id", F.col("k").alias("j"), F.col("sig").alias("y"))
    both = near.join(x, ["ctx_id", "i"]).join(y, ["ctx_id", "j"])
    return both.select("ctx_id", "i", "j", signature_similarity(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)


def _components(part: pd.DataFrame) -> pd.DataFrame:
    """Components of one context's pairs, named by their smallest member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(part["i"].tolist(), part["j"].tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"ctx_id": part["ctx_id"].iloc[0], "rep": list(parent), "component": [root(x) for x in parent]})


def clusters(segments: DataFrame, threshold: float, similarity: str = "jaccard", paths: list[str] | None = None) -> DataFrame:
    """``ctx_id, seg_idx, rep, component``: the class of each segment, and its cluster closed under links (its smallest segment)."""
    sets = keep(shingle_sets(segments), "shingle-sets", paths)  # looked at several times
    pairs = (jaccard_pairs if similarity == "jaccard" else minhash_pairs)(sets, threshold)
    linked = pairs.select("ctx_id", "i", "j").groupBy("ctx_id").applyInPandas(_components, "ctx_id bigint, rep int, component int")
    rows = sets.select("ctx_id", "seg_idx", "rep").join(linked, ["ctx_id", "rep"], "left")
    return rows.select("ctx_id", "seg_idx", "rep", F.coalesce("component", "rep").alias("component"))


def representatives(clustered: DataFrame, score: str) -> DataFrame:
    """Adds ``rep_idx``: the member of the cluster with the highest ``score``, the first of equals."""
    w = W.partitionBy("ctx_id", "component")
    best = F.max(F.struct(F.col(score), -F.col("seg_idx"))).over(w)
    return clustered.withColumn("__best", best).withColumn("rep_idx", (-F.col("__best.col2")).cast("int")).drop("__best")


def redundancy(segments: DataFrame) -> DataFrame:
    """``ctx_id, redundant, redundant_tokens, unique``: how many segments are redundant, their tokens, and the indices of the others in order."""
    flag = F.col("is_redundant")
    unique = F.array_sort(F.collect_list(F.when(~flag, F.col("seg_idx"))))
    return segments.groupBy("ctx_id").agg(
        F.sum(flag.cast("bigint")).alias("redundant"), F.sum(F.when(flag, F.col("tokens")).otherwise(0)).cast("bigint").alias("redundant_tokens"), unique.alias("unique"),
    )
