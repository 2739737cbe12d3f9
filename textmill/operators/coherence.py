"""Warnings where a kept segment follows a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill.functions import rules
from textmill.functions.text import utrim

PREVIEW_BYTES = 50


def warnings(kept: DataFrame) -> DataFrame:
    """``ctx_id, seg_idx, kind, preview`` for kept segments (``ctx_id, seg_idx, text``); order within a segment is that of the kinds."""
    before = F.lag("seg_idx").over(W.partitionBy("ctx_id").orderBy("seg_idx"))
    rows = kept.select("ctx_id", "seg_idx", "text", before.alias("before"))
    rows = rows.where(F.col("seg_idx") > F.coalesce(F.col("before") + 1, F.lit(0)))
    t = F.col("text")
    dangling = rules.matches(t, rules.DANGLING_REFERENCE)
    kinds = (
        ("orphaned pronoun", rules.matches(t, rules.ORPHANED_PRONOUN)), ("dangling reference", dangling),
        ("incomplete list", rules.matches(t, rules.INCOMPLETE_LIST)), ("orphaned code reference", dangling | rules.matches(t, rules.CODE_REFERENCE)),
    )
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]), lambda k: k.isNotNull())
    return rows.select("ctx_id", "seg_idx", F.explode(found).alias("kind"), preview(t).alias("preview"))


def preview(text):
    """The first 50 bytes of the trimmed text, less a character that the limit would cut."""
    t = utrim(text)
    head = F.left(t, F.lit(PREVIEW_BYTES))
    # a character has at most four bytes: the longest prefix of characters that fits
    n = F.element_at(F.filter(F.sequence(F.least(F.length(head), F.lit(PREVIEW_BYTES)), F.lit(0), F.lit(-1)), lambda k: F.octet_length(F.left(head, k)) <= PREVIEW_BYTES), 1)
    return F.when(F.octet_length(t) <= PREVIEW_BYTES, t).otherwise(F.left(head, n))
