"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two fingerprints are linked if they differ in at most ``radius`` bits. Give every bit position
``i`` a vector ``m(i)`` of ``radius + 1`` binary digits, not all zero. For each of the ``2**(radius+1) - 1`` nonzero vectors
``v`` there is a table whose mask keeps the bits with ``<m(i), v> = 1``. Any ``radius`` differing positions span a space of
less than ``radius + 1`` dimensions, so some ``v`` is orthogonal to them all, and in that table the pair has the same key:
no linked pair is lost. For radius 3 there are 15 tables with about 34 bits each.

Equal fingerprints are merged before anything else, so thousands of exact copies count once. A bucket of one table holds
distinct fingerprints that agree in some 34 bits. Buckets of up to ``DIRECT`` members are searched directly, in blocks;
larger ones are dealt again by 15 masks over their free bits, after which at most ``2**(free - kept)`` fingerprints can
agree, whatever the size of the corpus. Buckets give spanning forests of their links rather than all pairs.

Edge cases: null and empty texts have no words and fingerprint zero, which links like any other; with fewer words than a
shingle the whole sequence is the only shingle; an empty table gives an empty table; equal ids with different texts stay
separate rows; other columns are ignored by :func:`classes` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import col, components, fresh, materialize, words_of

DIRECT = 1 << 14
SKETCH = 128
#: Equal places of sketches: pairs with as many as the first are similar but for a chance below one in ten thousand, those with
#: fewer than the last are not but for one in two hundred; between them sets of shingles decide. At a similarity of 0.8.
SURE, LEAST = 120, 90
_LEVELS = (SURE, 112, 107, 103, 98, 94, LEAST)
_BLOCK = 128
_A = np.random.default_rng(42).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(43).integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of ``size`` words, repeats included."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    f = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([f(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    return np.array([f(joined[i:j], 42) for i, j in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of a text: a bit is set if it is set in more than half of the shingles' hashes."""
    words = words_of(text)
    h = shingle_hashes([w.lower() for w in words], size)  # bytes.lower touches A-Z only
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    full = len(bits) // 255 * 255
    ones = bits[full:].sum(0, dtype=np.int64)
    if full:
        ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprint_udf(size: int):
    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return run.asNondeterministic()


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits``: one for each nonzero vector of ``radius + 1`` digits. Vectors are dealt out in turn."""
    span = 1 << (radius + 1)
    vec = {b: 1 + k % (span - 1) for k, b in enumerate(bits)}
    masks = (sum(1 << b for b in bits if (vec[b] & v).bit_count() & 1) for v in range(1, span))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that span the links among distinct ``prints``; no list of all pairs is made."""
    n = len(prints)
    if n == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= radius else []
    out: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = []
            for lo in range(0, len(frontier), _BLOCK):
                if not len(rest):
                    break
                part = frontier[lo : lo + _BLOCK]
                near = np.bitwise_count(prints[part][:, None] ^ prints[rest][None, :]) <= radius
                hit = near.any(0)
                if hit.any():
                    out += zip(part[near[:, hit].argmax(0)].tolist(), rest[hit].tolist(), strict=True)
                    reached.append(rest[hit])
                    rest = rest[~hit]
            frontier = np.concatenate(reached) if reached else rest[:0]
    return out


def _forest_udf(radius: int):
    edge = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    @F.pandas_udf(edge)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prints, reps in batches:
            out = []
            for p, r in zip(prints, reps, strict=True):
                p = np.asarray(p, dtype=np.int64).view(np.uint64)
                out.append([(int(r[i]), int(r[j])) for i, j in forest(p, radius)])
            yield pd.Series(out)

    return run.asNondeterministic()


def links(reps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between ``rep`` ids that span all links of the distinct fingerprints in ``reps(fp, rep)``."""
    masks = covering_masks(list(range(64)), radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    dealt = reps.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.t", "k.key")
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "buckets")
    shared = dealt.join(sizes, ["t", "key"])
    small = shared.where(F.col("n") <= DIRECT).select("t", "key", F.lit(-1).alias("u"), F.lit(0).cast("long").alias("sub"), "fp", "rep")
    members = small
    if not sizes.where(F.col("n") > DIRECT).isEmpty():
        again = []
        for t, m in enumerate(masks):
            free = [b for b in range(64) if not (m >> b) & 1]
            sub = covering_masks(free, radius)
            again.append(F.when(F.col("t") == t, F.array(*[F.struct(F.lit(u).alias("u"), F.col("fp").bitwiseAND(F.lit(s)).alias("sub")) for u, s in enumerate(sub)])))
        large = shared.where(F.col("n") > DIRECT).select("t", "key", "fp", "rep", F.explode(F.coalesce(*again)).alias("s"))
        members = small.unionByName(large.select("t", "key", "s.u", "s.sub", "fp", "rep"))
    grouped = members.groupBy("t", "key", "u", "sub").agg(F.collect_list(F.struct("fp", "rep")).alias("l")).where(F.size("l") > 1)
    edges = grouped.select(F.explode(_forest_udf(radius)(F.col("l.fp"), F.col("l.rep"))).alias("e"))
    return edges.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``component_id`` is the smallest id reachable by links, itself included."""
    prints = docs.select(col(id_col).alias("doc_id"), _fingerprint_udf(size)(col(text_col)).alias("fp"))
    return _label(materialize(prints, "simhash"), radius)


def _label(prints: DataFrame, radius: int) -> DataFrame:
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-reps")
    labels = components(links(reps.select("fp", F.col("fp").alias("rep")), radius))
    named = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    named = materialize(named, "simhash-classes")
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    # a hot fingerprint is a skewed join, which is split
    return prints.join(named.join(least, "class").select("fp", "component_id"), "fp")


# --- near copies by shingle similarity ------------------------------------------------------------------------------


def profile(text: str | None, size: int, prints: int) -> tuple[int, list[int], bytes]:
    """Hash of the words, ``prints`` fingerprints of the set of words, and a sketch of the set of shingles.

    A few changed words turn fewer bits of a fingerprint of words than of one of shingles; the sketch (``SKETCH`` minima,
    a byte of each) then tells how similar the shingles are.
    """
    words = [w.lower() for w in words_of(text)]
    whole = xxhash.xxh64(b" ".join(words), 42).intdigest()
    whole -= (whole >> 63) << 64
    if not words:
        return whole, [0] * prints, bytes(SKETCH)
    f = xxhash.xxh64_intdigest
    kinds = set(words)
    h = np.fromiter((f(w, 42) for w in kinds), dtype=np.uint64, count=len(kinds))
    out = []
    for k in range(prints):
        x = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & (1 << 64) - 1 | 1)
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 255 * 255
        ones = bits[full:].sum(0, dtype=np.int64)
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(x)).astype(np.uint8), bitorder="little").view("<i8")[0]))
    g = np.unique(shingle_hashes(words, size))
    least = np.full(SKETCH, (1 << 64) - 1, dtype=np.uint64)
    for lo in range(0, len(g), 2000):
        x = g[lo : lo + 2000, None] * _A[None, :] + _B[None, :]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    least = least * np.uint64(0xD6E8FEB86659FD93)  # minima are small numbers; mixed, any byte of them will do
    return whole, out, (least >> np.uint64(56)).astype(np.uint8).tobytes()


def _profile_udf(size: int, prints: int):
    @F.pandas_udf("whole bigint, prints array<bigint>, sketch binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([profile(t, size, prints) for t in texts], columns=["whole", "prints", "sketch"])

    return run.asNondeterministic()


def similar_forest(prints: np.ndarray, sketches: np.ndarray, radius: int, least: int) -> list[tuple[int, int]]:
    """Index pairs that span the links: fingerprints within ``radius`` and sketches that agree in ``least`` places or more."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        lo, step = 0, 1
        while lo < len(frontier) and len(rest):
            part = frontier[lo : lo + step]
            lo, step = lo + step, min(2 * step, 32)
            near = np.bitwise_count(prints[part][:, None] ^ prints[rest][None, :]) <= radius
            i, j = np.nonzero(near)
            same = np.concatenate([(sketches[part[i[k : k + 50_000]]] == sketches[rest[j[k : k + 50_000]]]).sum(1) for k in range(0, len(i), 50_000)]) if len(i) else i
            i, j = i[same >= least], j[same >= least]
            if len(j):
                j, first = np.unique(j, return_index=True)
                out += zip(part[i[first]].tolist(), rest[j].tolist(), strict=True)
                frontier = np.concatenate([frontier, rest[j]])
                rest = np.delete(rest, j)
    return out


def best_forest(prints: np.ndarray, sketches: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """``(i, j, equal places)``: like :func:`similar_forest`, but whatever number of places is asked for, its links connect what links of
    that many places connect; so links that fail a later test leave the better ones standing."""
    low = similar_forest(prints, sketches, radius, LEAST)
    if not low:
        return []
    label, out = np.arange(len(prints)), []
    for level in _LEVELS:
        for i, j in low if level == LEAST else similar_forest(prints, sketches, radius, level):
            if label[i] != label[j]:
                out.append((i, j, int((sketches[i] == sketches[j]).sum())))
                label[label == label[j]] = label[i]
        if len(out) == len(low):
            break
    return out


def similar_links(reps: DataFrame, prints: int, radius: int) -> DataFrame:
    """Edges ``(a, b, same)`` between ``whole`` hashes: in one of the fingerprints within ``radius``, ``same`` places of the sketches equal."""
    edge = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("same", T.IntegerType())]))

    @F.pandas_udf(edge)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for fps, wholes, sketches in batches:
            out = []
            for f, w, s in zip(fps, wholes, sketches, strict=True):
                f, s = np.asarray(f, dtype=np.int64).view(np.uint64), np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1)
                out.append([(int(w[i]), int(w[j]), n) for i, j, n in best_forest(f, s, radius)])
            yield pd.Series(out)

    edges = None
    for k in range(prints):
        mine = reps.select("whole", F.element_at("prints", k + 1).alias("fp"))
        # a bucket's name is a hash of its table and key; should two buckets share one, they are searched together
        masks = covering_masks(list(range(64)), radius)
        keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
        dealt = mine.select("whole", F.explode(keys).alias("key"))
        sizes = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        shared = dealt.join(sizes, "key")
        # a bucket beyond DIRECT is dealt again by the sketch: near copies of one text agree in most bytes of it, so four
        # bytes at a time, in 32 ways, leave pairs of similarity 0.8 together in some way
        members = shared.where(F.col("n") <= DIRECT).select("key", F.lit(-1).alias("u"), F.lit(0).cast("long").alias("sub"), "whole")
        if not sizes.where(F.col("n") > DIRECT).isEmpty():
            large = shared.where(F.col("n") > DIRECT).join(reps.select("whole", "sketch"), "whole")
            ways = F.array(*[F.struct(F.lit(u).alias("u"), F.xxhash64(F.substring("sketch", 4 * u + 1, 4)).alias("sub")) for u in range(SKETCH // 4)])
            members = members.unionByName(large.select("key", "whole", F.explode(ways).alias("s")).select("key", "s.u", "s.sub", "whole"))
        full = members.join(reps.select("whole", F.element_at("prints", k + 1).alias("fp"), "sketch"), "whole")
        grouped = full.groupBy("key", "u", "sub").agg(F.collect_list(F.struct("fp", "whole", "sketch")).alias("l")).where(F.size("l") > 1)
        got = grouped.select(F.explode(run.asNondeterministic()(F.col("l.fp"), F.col("l.whole"), F.col("l.sketch"))).alias("e"))
        got = got.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"), "e.same").distinct()
        got = materialize(got, "similar")
        edges = got if edges is None else edges.unionByName(got)
    return materialize(edges.distinct(), "similar-all")


def _sets_udf(size: int):
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes([w.lower() for w in words_of(t)], size)).tobytes() for t in texts], dtype=object)

    return run.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def _jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(x, y, strict=True):
        a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(both / max(1, len(a) + len(b) - both))
    return pd.Series(out, dtype=float)


def decided(edges: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The edges whose texts (``whole, text``) have sets of ``size``-word shingles as similar as asked for."""
    open_ = edges.where(F.col("same") < SURE)
    ends = open_.select(F.explode(F.array("a", "b")).alias("whole")).distinct()
    sets = texts.join(ends, "whole", "left_semi").groupBy("whole").agg(F.first("text").alias("text"))
    sets = materialize(sets.select("whole", _sets_udf(size)("text").alias("shingles")), "near-sets")
    both = open_.join(sets.select(F.col("whole").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("whole").alias("b"), F.col("shingles").alias("y")), "b")
    good = both.where(_jaccard("x", "y") >= similarity).select("a", "b")
    return edges.where(F.col("same") >= SURE).select("a", "b").unionByName(good)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, prints: int = 10, radius: int = 3,
) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest id.

    Texts with the same words are one group; others are linked if one of ``prints`` fingerprints of their words differs in
    at most ``radius`` bits and their sets of ``size``-word shingles are similar: plainly so by their sketches, or, where those
    are not plain, by the sets themselves. Groups are closed under links. The bounds ``SURE`` and ``LEAST`` are for a
    similarity of 0.8; others are refused.
    """
    if similarity != 0.8:
        raise ValueError("the sketches' bounds are for a similarity of 0.8")
    i, w, x = (fresh(docs, f"near{k}") for k in "iwx")
    flat = docs.select(col(id_col).alias("id"), _profile_udf(size, prints)(col(text_col)).alias("p")).select("id", "p.*")
    reps = flat.groupBy("whole").agg(F.min("id").alias("id"), F.first("prints").alias("prints"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "near-reps")
    texts = docs.select(whole_of(col(text_col)).alias("whole"), col(text_col).alias("text"))
    labels = components(decided(similar_links(reps, prints, radius), texts, size, similarity))
    named = reps.select("whole", "id").join(labels, reps["whole"] == labels["node"], "left").select("whole", "id", F.coalesce("component", "whole").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct("id", "whole")).alias("b"))
    kept = materialize(best.select(F.col("b.id").alias(i), F.col("b.whole").alias(w)), "near-kept")
    rows = docs.withColumn(x, whole_of(col(text_col)))
    rows = rows.join(kept, col(id_col).eqNullSafe(col(i)) & (col(x) == col(w)), "left_semi")
    # of identical rows one stays
    return rows.dropDuplicates([id_col, x]).select(*[col(c) for c in docs.columns])


def whole_of(text: Column) -> Column:
    """The hash of the words that :func:`profile` gives: Spark's xxhash64 is XXH64 with seed 42."""
    upper = "".join(map(chr, range(65, 91)))
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[\x20\x09-\x0D]+", " ")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
