"""Texts to segments: ``seg_idx, text, start, end, is_code_block, heading_level`` for each row of a context.

Lines and paragraphs are native generators; modes that need a state machine run as one Arrow function from text to an
array of segments, which is then exploded. Input is partitioned by context once, and all windows reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions.text import MAX_BYTES, MIN_BYTES, first_line, heading_level, leading_bytes, utrim, without_return
from textmill.operators import segment_text

_PIECES = "array<struct<text:string,start:bigint,end:bigint,is_code_block:boolean,heading_level:tinyint>>"


def _pieces(cut):
    @F.pandas_udf(_PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                rows = cut(t) if t else []
                out.append([{"text": x, "start": a, "end": b, "is_code_block": c, "heading_level": h} for x, a, b, c, h in rows])
            yield pd.Series(out)

    return run.asNondeterministic()


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("seg_idx", (F.row_number().over(W.partitionBy("ctx_id").orderBy(*order)) - 1).cast("int"))


_OUT = ("seg_idx", "text", "start", "end", "is_code_block", "heading_level")


def _parts(contexts: DataFrame, separator: str, width: int) -> DataFrame:
    """Parts between separators, with the byte where each begins."""
    keep = [c for c in contexts.columns if c != "text"]
    rows = contexts.select(*keep, F.posexplode(F.split("text", separator, -1)).alias("pos", "raw"))
    before = F.sum(F.octet_length("raw") + width).over(W.partitionBy("ctx_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("at", F.coalesce(before, F.lit(0)).cast("bigint"))


def by_line(contexts: DataFrame) -> DataFrame:
    keep = [c for c in contexts.columns if c != "text"]
    rows = _parts(contexts, "\n", 1).withColumn("line", without_return(F.col("raw"))).withColumn("text", utrim(F.col("line")))
    rows = _numbered(rows.where(F.octet_length("text") >= MIN_BYTES), "pos")
    return rows.select(
        *keep, "seg_idx", "text", F.col("at").alias("start"), (F.col("at") + F.octet_length("line")).alias("end"), F.lit(False).alias("is_code_block"),
        heading_level(F.col("line")).alias("heading_level"),
    )


def by_paragraph(contexts: DataFrame) -> DataFrame:
    """Paragraphs; those over the limit, and those alone, pass through the Arrow function that cuts them."""
    keep = [c for c in contexts.columns if c != "text"]
    rows = _parts(contexts, "\n\n", 2).withColumn("text", utrim(F.col("raw"))).where(F.octet_length("text") >= MIN_BYTES)
    rows = rows.withColumn("start", F.col("at") + leading_bytes(F.col("raw"))).select(*keep, "pos", "text", "start")
    long = F.octet_length("text") > MAX_BYTES
    cut = _pieces(lambda t: [(x, a, b, False, segment_text.level_of(x.split("\n", 1)[0]) if k == 0 else 0) for k, (x, a, b) in enumerate(segment_text.cut_long(t))])
    one = F.array(F.struct(
        F.col("text").alias("text"), F.lit(0).cast("bigint").alias("start"), F.octet_length("text").cast("bigint").alias("end"), F.lit(False).alias("is_code_block"),
        heading_level(first_line(F.col("text"))).alias("heading_level"),
    ))
    rows = rows.withColumn("cut", cut(F.when(long, F.col("text")))).withColumn("cut", F.when(long, F.col("cut")).otherwise(one))
    rows = rows.select(*keep, "pos", F.col("start").alias("base"), F.posexplode("cut").alias("sub", "s"))
    rows = _numbered(rows, "pos", "sub")
    return rows.select(*keep, "seg_idx", F.col("s.text").alias("text"), (F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end"), "s.is_code_block", "s.heading_level")


def _by_function(contexts: DataFrame, cut) -> DataFrame:
    keep = [c for c in contexts.columns if c != "text"]
    rows = contexts.select(*keep, _pieces(cut)(F.col("text")).alias("cut")).select(*keep, F.posexplode("cut").alias("seg_idx", "s"))
    return rows.select(*keep, "seg_idx", "s.*")


def segment(contexts: DataFrame, mode: str = "paragraph", preserve_code: bool = False, compat: str = "fixed") -> DataFrame:
    """Segments of every context (``ctx_id, text`` and any further columns, which are kept)."""
    if mode == "semantic":
        return _by_function(contexts, lambda t: segment_text.semantic(t, compat))
    if preserve_code:
        return _by_function(contexts, lambda t: segment_text.with_code(t, mode, compat))
    if mode == "line":
        return by_line(contexts)
    if mode == "sentence":
        return _by_function(contexts, segment_text.sentences)
    return by_paragraph(contexts)


def reassemble(segments: DataFrame, kept: Column | None = None) -> DataFrame:
    """``ctx_id, output``: the segments where ``kept`` holds, in order, joined by a blank line."""
    rows = segments if kept is None else segments.where(kept)
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return rows.groupBy("ctx_id").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n\n").alias("output"))
