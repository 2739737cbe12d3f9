"""The whole compression as one plan over many contexts.

``contexts`` has ``ctx_id`` (of any type) and ``text``. Contexts, segments and analysed segments are written to the shared folder
once each, and everything that is returned is read from these tables; so a text is segmented once, whatever is asked for.
Contexts that fit their budget leave before terms, pairs and selection are worked out. Inside, a row's own number stands for its
id: null ids are ids like any other, and rows that share one are compressed each by itself.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmill import progress as progress_
from textmill.config import MODELS, ConfigError, Options, available, model_budget
from textmill.functions.rules import boilerplate_score, check_patterns
from textmill.functions.text import utrim
from textmill.functions.tokens import bpe_at_hand, counter
from textmill.operators import coherence, dedup, score, select, stats, terms
from textmill.operators.segment import reassemble, segment
from textmill.storage import delete, keep


@dataclass(frozen=True)
class Compressed:
    """``results``: ctx_id, output, status; ``stats``; ``warnings``; ``segments``: analysed segments of compressed contexts with ``selected``.

    All four are read from tables in the shared folder, which :meth:`release` deletes.
    """

    results: DataFrame
    stats: DataFrame
    warnings: DataFrame
    segments: DataFrame
    paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        delete(self.results.sparkSession, self.paths)


def count_of(options: Options) -> Callable[[Column], Column]:
    """How tokens are counted. Reference compatibility counts byte pairs unless told otherwise; where no vocabulary can be had, words, with a warning."""
    name = options.counter
    if options.tokenizer is None and name == "openai" and not options.vocabulary and not bpe_at_hand():
        warnings.warn("no vocabulary for byte-pair counts; counting words instead (name a vocabulary file)", stacklevel=2)
        name = "approximate"
    return counter(name, options.vocabulary, options.vocabulary_pattern)


def budget_column(text: Column, options: Options) -> Column:
    """Each context's budget in tokens."""
    b = options.budget
    if b.column is not None:
        return F.col(b.column).cast("bigint")
    if b.tokens is not None:
        if b.tokens <= 0:
            raise ConfigError("budget is zero")
        return F.lit(b.tokens).cast("bigint")
    if b.share is not None:
        return F.ceil(count_of(options)(text) * F.lit(float(b.share))).cast("bigint")
    if b.model_column is not None:
        # unknown models, and reserves that leave nothing, give a budget error for their rows
        window = F.coalesce(*[F.when(F.lower(b.model_column) == m, F.lit(w)) for m, w in MODELS.items()], F.lit(0))
        return F.greatest(F.lit(0), window - b.reserve).cast("bigint")
    return F.lit(model_budget(b.model, b.reserve)).cast("bigint")


def cut(contexts: DataFrame, options: Options) -> DataFrame:
    """Segments with ``tokens``, ``n`` (segments of the context) and ``total`` (their tokens); columns of the contexts but the text are kept."""
    rows = segment(contexts, options.mode, options.preserve_code, options.compat)
    rows = rows.withColumn("tokens", count_of(options)(F.col("text")))
    w = W.partitionBy("ctx_id")
    return rows.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("tokens").over(w))


def analyze(segments: DataFrame, options: Options, paths: list[str] | None = None) -> DataFrame:
    """Adds scores and flags to the segments of :func:`cut`."""
    t = options.thresholds
    scored = segments.join(terms.tfidf(segments), ["ctx_id", "seg_idx"], "left").withColumn("tfidf_score", F.coalesce("tfidf_score", F.lit(0.0)))
    text = F.col("text")
    scored = scored.withColumn("boilerplate_score", boilerplate_score(text, options.boilerplate_patterns))
    reference = options.compat == "reference"
    flagged = F.col("boilerplate_score") >= t.boilerplate
    scored = scored.withColumn("is_boilerplate", flagged if options.boilerplate or reference else F.lit(False)).withColumn("is_preserved", F.col("is_code_block"))
    scored = scored.withColumn("importance0", F.col("tfidf_score") * score.position_factor(F.col("seg_idx"), F.col("n"), t.decay))
    if options.redundancy or reference:
        groups = dedup.clusters(segments, t.similarity, options.likeness, paths)
        scored = scored.join(groups.select("ctx_id", "seg_idx", "component"), ["ctx_id", "seg_idx"])
        scored = dedup.representatives(scored, "importance0").withColumn("is_redundant", F.col("rep_idx") != F.col("seg_idx"))
        if reference:
            second = F.col("is_redundant") if options.redundancy else F.lit(False)
            scored = scored.withColumn("__second", second).drop("rep_idx")
            first = dedup.representatives(scored, "tfidf_score").withColumn("__first", F.col("rep_idx") != F.col("seg_idx"))
            scored = first.withColumn("is_redundant", F.col("__first") | F.col("__second")).withColumn("newly", F.col("__second") & ~F.col("__first"))
            scored = scored.drop("__first", "__second")
        else:
            scored = scored.withColumn("newly", F.col("is_redundant"))
        scored = scored.drop("component", "rep_idx")
    else:
        scored = scored.withColumn("is_redundant", F.lit(False)).withColumn("newly", F.lit(False))
    value = score.importance(F.col("seg_idx"), F.col("n"), text, F.col("tokens"), F.col("tfidf_score"), F.col("is_boilerplate"), F.col("is_redundant"), t.decay, options.preserve_patterns)
    return scored.withColumn("importance_score", value)


def choose(analyzed: DataFrame, options: Options) -> DataFrame:
    """``ctx_id, seg_idx`` of the segments that stay; ``analyzed`` has a ``budget`` column."""
    if options.head or options.tail:
        return select.with_ends(analyzed, options.head, options.tail, options.compat == "fixed")
    if options.extractive:
        return select.extractive(analyzed, options.thresholds.importance_min)
    return select.fit(analyzed)


def compress(contexts: DataFrame, options: Options, progress: Callable[[str], None] = progress_.quiet) -> Compressed:
    """Compresses every context. The analysis runs at once, the frames are computed when they are used.

    ``status`` says what became of a context: ``empty_input`` (blank; no output), ``no_segments`` and ``pass_through`` (the
    text as it was), ``budget_error`` (a budget of 0 or less than head and tail; no output) or ``compressed``. A budget column that
    is null counts as 0.
    """
    options.check()
    check_patterns(contexts.sparkSession, options.boilerplate_patterns + options.preserve_patterns)
    if options.budget.tokens:
        available(options.budget.tokens, options.head, options.tail)
    count, paths = count_of(options), []
    base = contexts.withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("budget", F.coalesce(budget_column(F.col("text"), options), F.lit(0))).select(F.monotonically_increasing_id().alias("row"), "ctx_id", "text", "budget")
    base = keep(base, "contexts", paths)  # from here on the numbers stay as they are
    names = base.select("row", F.col("ctx_id").alias("name"))
    named = lambda df: df.join(names, df["ctx_id"] == names["row"]).select(F.col("name").alias("ctx_id"), *[c for c in df.columns if c != "ctx_id"])
    base = base.select(F.col("row").alias("ctx_id"), "text", "budget")
    progress("segmenting")
    pieces = keep(cut(base.repartition("ctx_id"), options), "segments", paths)
    over = pieces.where((F.col("total") > F.col("budget")) & (F.col("budget") > 0) & (F.col("budget") >= options.head + options.tail))
    progress("analyzing redundancy")
    analyzed = analyze(over, options, paths)
    progress("analyzing importance")
    analyzed = keep(analyzed, "analyzed", paths)
    progress("compressing")
    chosen = choose(analyzed, options).withColumn("__in", F.lit(True))
    marked = analyzed.join(chosen, ["ctx_id", "seg_idx"], "left").withColumn("selected", F.coalesce("__in", F.lit(False))).drop("__in")
    marked = keep(marked, "marked", paths)
    progress("reassembling")

    switched = lambda on, flag: F.sum(F.when(F.col(flag), F.col("tokens")).otherwise(0)) if on else F.lit(0)
    kept = F.when(F.col("selected"), F.col("tokens")).otherwise(0)
    told = marked.groupBy("ctx_id").agg(
        F.sum(kept).alias("compressed_tokens"), F.sum(F.col("selected").cast("bigint")).alias("segments_kept"),
        switched(options.redundancy, "newly").alias("redundancy_removed"), switched(options.boilerplate, "is_boilerplate").alias("boilerplate_removed"),
    )
    totals = pieces.groupBy("ctx_id").agg(F.max("total").alias("total"), F.max("n").alias("n"))
    rows = base.join(totals, "ctx_id", "left").join(told, "ctx_id", "left")
    status = (
        F.when(utrim(F.col("text")) == "", "empty_input").when(F.col("n").isNull(), "no_segments").when(F.col("budget") <= 0, "budget_error")
        .when(F.col("total") <= F.col("budget"), "pass_through").when(F.col("budget") < options.head + options.tail, "budget_error").otherwise("compressed")
    )
    rows = rows.withColumn("status", status)
    whole = F.col("status") == "compressed"
    original = F.when(F.col("n").isNull(), F.when(F.col("status") == "no_segments", count(F.col("text"))).otherwise(F.lit(0))).otherwise(F.col("total")).cast("bigint")
    zero = lambda c: F.when(whole, F.col(c)).otherwise(F.lit(0)).cast("bigint")
    per = rows.select(
        "ctx_id", original.alias("original_tokens"), F.when(whole, F.col("compressed_tokens")).otherwise(original).cast("bigint").alias("compressed_tokens"), zero("redundancy_removed").alias("redundancy_removed"),
        zero("boilerplate_removed").alias("boilerplate_removed"), F.when(whole, F.col("segments_kept")).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("segments_kept"), F.coalesce("n", F.lit(0)).cast("bigint").alias("segments_total"), whole.alias("__c"),
    )
    removed = stats.extractive_removed(F.col("original_tokens"), F.col("redundancy_removed"), F.col("boilerplate_removed"), F.col("compressed_tokens"))
    per = per.withColumn("extractive_removed", F.when(F.col("__c"), removed).otherwise(F.lit(0).cast("bigint"))).drop("__c")
    per = stats.derive(per.select("ctx_id", *stats.COUNTS))

    built = reassemble(marked, F.col("selected"))
    results = rows.select("ctx_id", "text", "status").join(built, "ctx_id", "left")
    output = F.when(F.col("status").isin("pass_through", "no_segments"), F.col("text")).when(F.col("status") == "compressed", F.coalesce("output", F.lit("")))
    results = results.select("ctx_id", output.alias("output"), "status")
    seen = marked.where("selected") if options.compat == "fixed" else marked.where("not is_redundant and not is_boilerplate")
    told = coherence.warnings(seen.select("ctx_id", "seg_idx", "text"))
    return Compressed(named(results), named(per), named(told), named(marked), paths)


def plain(options: Options, **changes) -> Options:
    """Options with changes."""
    return replace(options, **changes)
