"""The engine's queries on the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.config import MODELS, Budget, Options, Thresholds
from textmill.functions.rules import AGAIN, BOILERPLATE, CODE_REFERENCE, DANGLING_REFERENCE, INCOMPLETE_LIST, ORPHANED_PRONOUN
from textmill.functions.rules import boilerplate_score as boilerplate
from textmill.functions.tokens import bpe, counter
from textmill.operators import dedup, score, select, stats, terms
from textmill.operators.segment import segment
from textmill.plans import pipeline
from textmill.sources.contexts import from_conversations, from_table
from textmill.storage import keep

HALF = Options(budget=Budget(share=0.5), mode="line")
USER_RULE = r"(?i)^(licensed|released) under"
FLAGS = Thresholds(boilerplate=0.8)


def _docs(spark, sf: str, *keep: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", *keep)


def _lines(spark, sf: str) -> DataFrame:
    return segment(_docs(spark, sf).repartition("ctx_id"), "line")


def _conversations(spark, sf: str) -> DataFrame:
    return from_conversations(spark.read.parquet(f"{sf}/conversations.parquet"))


def _sources(spark, sf: str) -> DataFrame:
    """Long contexts: each document three times over with spaces between, which passes the limit of a segment."""
    return _docs(spark, sf).withColumn("text", F.regexp_replace(F.concat_ws(" ", "text", "text", "text"), r"\n+", " "))


def _markdown(spark, sf: str) -> DataFrame:
    """Documents dressed as markdown: a heading, blank lines, a fenced last line."""
    lines = F.split("text", "\n")
    text = F.concat(F.lit("# "), F.element_at(lines, 1), F.lit("\n\n"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n\n"), F.lit("\n```text\n"), F.element_at(lines, -1), F.lit("\n```\n## End\nlast words here\n"))
    return _docs(spark, sf).withColumn("text", text)


def _cut(spark, sf: str, options: Options = HALF) -> DataFrame:
    base = _docs(spark, sf).withColumn("budget", pipeline.budget_column(F.col("text"), options))
    return keep(pipeline.cut(base.repartition("ctx_id"), options), "segments")


def _analyzed(spark, sf: str, options: Options = HALF) -> DataFrame:
    return pipeline.analyze(_cut(spark, sf, options), options)


#: Starts of lines that make :func:`_dressed` reach every rule; a line gets that of its place, counted over and over.
DRESS = (
    "## ", "Copyright (c) ", "MIT License ", "DO NOT EDIT ", "as mentioned above, ", "1. ", "the above code shows ", "=" * 24 + "\n", "Note: is it so? ", "import ", "All rights reserved by ",
    "permission is hereby granted for use of the software ", "THE SOFTWARE IS PROVIDED ", "They ", "- ", "def ", "", "",
)
DRESSED = Options(budget=Budget(tokens=150), mode="line")


def _dressed(spark, sf: str) -> DataFrame:
    """Documents whose lines begin with license lines, marks of generated text, references, list items, headings and so on."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(*map(F.lit, DRESS)), i % len(DRESS) + 1), x))
    return _docs(spark, sf).withColumn("text", F.array_join(lines, "\n"))


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def seg_line(spark, sf):
    return _lines(spark, sf).select("ctx_id", "seg_idx", "text", "start", "end", F.col("heading_level").cast("int").alias("heading_level"))


def seg_paragraph_conv(spark, sf):
    return segment(_conversations(spark, sf)).select("ctx_id", "seg_idx", "text", "start", "end", F.col("heading_level").cast("int").alias("heading_level"))


def _tokens(name):
    return lambda spark, sf: _lines(spark, sf).select("ctx_id", "seg_idx", counter(name)(F.col("text")).alias("tokens"))


def tokens_bpe(spark, sf):
    import public_tokenizers as public

    count = bpe(F.col("text"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return _lines(spark, sf).select("ctx_id", "seg_idx", count.alias("tokens"))


def budget_percent(spark, sf):
    o = Options(budget=Budget.parse("7%"))
    return _docs(spark, sf).select("ctx_id", counter("approximate")(F.col("text")).alias("whole"), pipeline.budget_column(F.col("text"), o).alias("budget"))


def budget_model(spark, sf):
    models = spark.createDataFrame([(m, w) for m, w in MODELS.items()], "model string, context_window bigint")
    usage = _docs(spark, sf).agg(F.max(counter("approximate")(F.col("text"))).alias("largest"))
    return models.crossJoin(usage).select("model", (F.col("context_window") - 4000).alias("budget"), (F.col("largest") <= F.col("context_window") - 4000).alias("all_fit"))


def term_freq(spark, sf):
    return terms.term_freq(_lines(spark, sf))


def doc_freq(spark, sf):
    return terms.doc_freq(terms.term_freq(_lines(spark, sf)))


def tfidf_score(spark, sf):
    return terms.tfidf(_lines(spark, sf)).select("ctx_id", "seg_idx", _r(F.col("tfidf_score"), "tfidf_score"))


def tfidf_foreign(spark, sf):
    """Benchmark items scored against each other's statistics without their own: all items are one context's segments."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lit(0).cast("bigint").alias("ctx_id"), F.col("item_id").cast("int").alias("seg_idx"), "text")
    known = bench.where("seg_idx % 2 = 0")
    df = terms.doc_freq(terms.term_freq(known))
    n = known.groupBy("ctx_id").agg(F.count("*").alias("n"))
    return terms.score_foreign(bench.where("seg_idx % 2 = 1"), df, n).select("ctx_id", "seg_idx", _r(F.col("tfidf_score"), "tfidf_score"))


def boilerplate_score(spark, sf):
    rows = _lines(spark, sf).select("ctx_id", "seg_idx", boilerplate(F.col("text"), (USER_RULE,)).alias("boilerplate_score"))
    return rows.where("boilerplate_score > 0")


def boilerplate_flag(spark, sf):
    rows = _lines(spark, sf).select("ctx_id", (boilerplate(F.col("text"), (USER_RULE,)) >= FLAGS.boilerplate).alias("b"))
    return rows.groupBy("ctx_id").agg(F.sum(F.col("b").cast("bigint")).alias("flagged"), F.count("*").alias("segments")).where("flagged > 0")


def boilerplate_dressed(spark, sf):
    rows = segment(_dressed(spark, sf).repartition("ctx_id"), "line")
    return rows.select("ctx_id", "seg_idx", F.col("heading_level").cast("int").alias("heading_level"), boilerplate(F.col("text")).alias("boilerplate_score"), (boilerplate(F.col("text")) >= 0.9).alias("flagged"))


def shingles(spark, sf):
    rows = _lines(spark, sf).select("ctx_id", "seg_idx", dedup.shingles(F.col("text")).alias("s"))
    return rows.select("ctx_id", "seg_idx", F.size("s").alias("n_shingles"), F.size(F.array_distinct("s")).alias("n_distinct"), F.array_join("s", "|").alias("shingles"))


def dup_classes(spark, sf):
    return dedup.shingle_sets(_lines(spark, sf)).select("ctx_id", "seg_idx", "rep")


def _pairs(join, threshold):
    def run(spark, sf):
        return join(keep(dedup.shingle_sets(_lines(spark, sf)), "shingle-sets"), threshold).select("ctx_id", "i", "j", _r(F.col("similarity"), "similarity"))

    return run


def dup_clusters(spark, sf):
    return dedup.clusters(_lines(spark, sf), 0.5).select("ctx_id", "seg_idx", "component")


def dup_representatives(spark, sf):
    rows = dedup.representatives(dedup.clusters(_lines(spark, sf), 0.5).withColumn("len", F.col("seg_idx") % 7), "len")
    return rows.select("ctx_id", "component", "rep_idx").distinct()


def position_decay(spark, sf):
    rows = _cut(spark, sf)
    return rows.select("ctx_id", "seg_idx", score.position_factor(F.col("seg_idx"), F.col("n"), 0.95).alias("factor"), _r(score.position_weight(F.col("seg_idx"), F.col("n"), 0.95), "weight"))


def structural_weight(spark, sf):
    return _lines(spark, sf).select("ctx_id", "seg_idx", _r(score.structural_weight(F.col("text")), "structural"))


def importance(spark, sf):
    rows = _analyzed(spark, sf)
    return rows.select("ctx_id", "seg_idx", "tokens", "is_boilerplate", "is_redundant", _r(F.col("importance0"), "importance0"), _r(F.col("importance_score"), "importance_score"))


def _selected(options):
    return lambda spark, sf: pipeline.choose(_analyzed(spark, sf, options), options).select("ctx_id", "seg_idx")


def _compressed(part):
    return lambda spark, sf: part(pipeline.compress(_docs(spark, sf), HALF), spark, sf)


def _rolled(done, spark, sf):
    per = done.stats.join(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ctx_id"), "lang", "source"), "ctx_id")
    return stats.rollup(per, "lang", "source").withColumn("compression_ratio", F.round("compression_ratio", 6))


def _segments(contexts, **options):
    return lambda spark, sf: segment(contexts(spark, sf), **options).select("ctx_id", "seg_idx", "text", "start", "end", "is_code_block", F.col("heading_level").cast("int").alias("heading_level"))


def _dressed_result(part):
    return lambda spark, sf: part(pipeline.compress(_dressed(spark, sf), DRESSED))


def _importance_dressed(spark, sf):
    done = pipeline.compress(_dressed(spark, sf), DRESSED).segments
    return done.select("ctx_id", "seg_idx", "tokens", "is_boilerplate", "is_redundant", _r(F.col("importance_score"), "importance_score"), "selected")


def _by_model(spark, sf):
    """Each document's budget by the model that its language is dealt to, an unknown one included."""
    names = [*MODELS, "unknown-model"]
    docs = _docs(spark, sf).withColumn("model", F.element_at(F.array(*map(F.lit, names)), (F.col("ctx_id") % len(names)).cast("int") + 1))
    budget = pipeline.budget_column(F.col("text"), Options(budget=Budget(model_column="model", reserve=8000)))
    return docs.select("ctx_id", "model", budget.alias("budget"))


FIT = Options(budget=Budget(share=0.5), mode="line", extractive=False)
ENDS = Options(budget=Budget(tokens=400), mode="line", head=60, tail=40)

QUERIES = {
    "seg_line": seg_line,
    "seg_paragraph_conv": seg_paragraph_conv,
    "tokens_approx": _tokens("approximate"),
    "tokens_wordchar": _tokens("word_char"),
    "tokens_bpe": tokens_bpe,
    "budget_percent": budget_percent,
    "budget_model": budget_model,
    "term_freq": term_freq,
    "doc_freq": doc_freq,
    "tfidf_score": tfidf_score,
    "tfidf_foreign": tfidf_foreign,
    "boilerplate_score": boilerplate_score,
    "boilerplate_flag": boilerplate_flag,
    "shingles": shingles,
    "dup_classes": dup_classes,
    "jaccard_pairs": _pairs(dedup.jaccard_pairs, 0.5),
    "minhash_pairs": _pairs(dedup.minhash_pairs, 0.85),
    "dup_clusters": dup_clusters,
    "dup_representatives": dup_representatives,
    "position_decay": position_decay,
    "structural_weight": structural_weight,
    "importance": importance,
    "select_extractive": _selected(HALF),
    "select_fit": _selected(FIT),
    "select_preserves": _selected(ENDS),
    "compressed_output": _compressed(lambda c, *_: c.results),
    "stats": _compressed(lambda c, *_: c.stats.withColumn("compression_ratio", F.round("compression_ratio", 6))),
    "stats_rollup": _compressed(_rolled),
    "stats_report": _compressed(lambda c, *_: stats.report(c.stats)),
    "stats_json": _compressed(lambda c, *_: stats.json(c.stats)),
    "coherence_warnings": _compressed(lambda c, *_: c.warnings),
    "seg_large_split": _segments(_sources),
    "seg_semantic": _segments(_markdown, mode="semantic"),
    "seg_semantic_reference": _segments(_markdown, mode="semantic", compat="reference"),
    "seg_code": _segments(_markdown, mode="paragraph", preserve_code=True),
    "seg_sentence": _segments(_docs, mode="sentence"),
    "boilerplate_dressed": boilerplate_dressed,
    "importance_dressed": _importance_dressed,
    "compressed_dressed": _dressed_result(lambda c: c.results),
    "stats_dressed": _dressed_result(lambda c: c.stats.withColumn("compression_ratio", F.round("compression_ratio", 6))),
    "warnings_dressed": _dressed_result(lambda c: c.warnings),
    "budget_verified": _dressed_result(lambda c: select.verify(c.segments)),
    "redundancy": _compressed(lambda c, *_: dedup.redundancy(c.segments).withColumn("unique", F.array_join("unique", ","))),
    "budget_model_column": _by_model,
}


# --- SQL ------------------------------------------------------------------------------------------------------------

_SEG = r"""
raw AS (SELECT doc_id AS ctx_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
placed AS (SELECT ctx_id, pos, regexp_replace(r, '\r$', '') AS line, regexp_replace(r, '^\s+|\s+$', '', 'g') AS text,
  coalesce(sum(strlen(r) + 1) OVER (PARTITION BY ctx_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM raw),
seg AS (SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY pos) - 1)::INTEGER AS seg_idx, text, off AS "start", (off + strlen(line))::BIGINT AS "end",
  length(regexp_extract(text, '^(#{1,6}) ', 1))::INTEGER AS heading_level FROM placed WHERE strlen(text) >= 10)"""


def _words(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"


def _approx(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN 0 ELSE greatest(1, ceil({_words(c)} * 1.3::DOUBLE)) END)::BIGINT"


_STEM = """CASE
  WHEN w LIKE '%ing' AND strlen(w) > 5 THEN CASE WHEN right(left(w, length(w) - 3), 2) IN ('ll', 'ss', 'zz') THEN left(w, length(w) - 4) ELSE left(w, length(w) - 3) END
  WHEN (w LIKE '%ed' OR w LIKE '%es') AND strlen(w) > 4 THEN left(w, length(w) - 2)
  WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND strlen(w) > 3 THEN left(w, length(w) - 1)
  WHEN w LIKE '%ly' AND strlen(w) > 4 THEN left(w, length(w) - 2)
  WHEN w LIKE '%tion' AND strlen(w) > 6 THEN left(w, length(w) - 4) || 'te'
  WHEN w LIKE '%ness' AND strlen(w) > 6 THEN left(w, length(w) - 4)
  ELSE w END"""
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(terms.STOPWORDS))


def _freq(source: str) -> str:
    return rf"""
loose AS (SELECT ctx_id, seg_idx, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM {source}),
freq AS (SELECT ctx_id, seg_idx, {_STEM} AS term, count(*) AS tf FROM loose WHERE strlen(w) > 1 AND w NOT IN ({_STOP}) GROUP BY ALL)"""


_TFIDF = """
known AS (SELECT f.*, count(*) OVER (PARTITION BY ctx_id, term) AS df, max(tf) OVER (PARTITION BY ctx_id, seg_idx) AS top FROM freq f),
sizes AS (SELECT ctx_id, count(*) AS n FROM seg GROUP BY 1),
tfidf AS (SELECT k.ctx_id, k.seg_idx, sum((0.5::DOUBLE + 0.5::DOUBLE * (tf::DOUBLE / top::DOUBLE)) * (ln((n + 1)::DOUBLE / (df + 1)::DOUBLE) + 1) ORDER BY term) / sqrt(count(*)::DOUBLE) AS tfidf_score
  FROM known k JOIN sizes s ON k.ctx_id = s.ctx_id GROUP BY 1, 2)"""


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''").replace(r"\z", "$") + "'"


def _boiler(c: str, extra: tuple[str, ...] = ()) -> str:
    rules = [(p, conf) for _, p, conf in BOILERPLATE] + [(p, 0.9) for n, p, _ in BOILERPLATE if n in AGAIN] + [(p, 0.9) for p in extra]
    best: dict[str, float] = {}
    for p, conf in rules:
        best[p] = max(conf, best.get(p, 0))
    whens = " ".join(f"WHEN regexp_matches({c}, {_quoted(p)}) THEN {conf}::DOUBLE" for p, conf in sorted(best.items(), key=lambda x: -x[1]))
    return f"(CASE {whens} ELSE 0::DOUBLE END)"


_SETS = r"""
ws AS (SELECT ctx_id, seg_idx, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM seg),
shs AS (SELECT ctx_id, seg_idx, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
  WHEN len(w) = 2 THEN list_concat(w, [array_to_string(w, ' ')]) ELSE w END AS s FROM ws),
sets AS (SELECT ctx_id, seg_idx, list_sort(list_distinct(s)) AS sh FROM shs),
classes AS (SELECT ctx_id, seg_idx, sh, min(seg_idx) OVER (PARTITION BY ctx_id, sh)::INTEGER AS rep FROM sets),
reps AS (SELECT ctx_id, rep AS k, sh, len(sh) AS n FROM classes WHERE seg_idx = rep),
each AS (SELECT ctx_id, k, n, unnest(sh) AS h FROM reps),
shared AS (SELECT a.ctx_id, a.k AS i, b.k AS j, a.n AS nx, b.n AS ny, count(*) AS c FROM each a JOIN each b ON a.ctx_id = b.ctx_id AND a.h = b.h AND a.k < b.k GROUP BY ALL)"""


def _pairs_sql(threshold: float) -> str:
    return f"pairs AS (SELECT ctx_id, i, j, c::DOUBLE / (nx + ny - c)::DOUBLE AS similarity FROM shared WHERE c::DOUBLE / (nx + ny - c)::DOUBLE >= {threshold}::DOUBLE)"


_CLUSTERS = """
reach AS (SELECT ctx_id, i AS a, j AS b FROM pairs UNION SELECT ctx_id, j, i FROM pairs UNION SELECT r.ctx_id, r.a, p.b FROM reach r JOIN (SELECT ctx_id, i AS a, j AS b FROM pairs UNION SELECT ctx_id, j, i FROM pairs) p ON r.ctx_id = p.ctx_id AND r.b = p.a),
least AS (SELECT ctx_id, a, min(least(a, b))::INTEGER AS component FROM reach GROUP BY 1, 2),
clusters AS (SELECT c.ctx_id, c.seg_idx, coalesce(l.component, c.rep)::INTEGER AS component FROM classes c LEFT JOIN least l ON c.ctx_id = l.ctx_id AND c.rep = l.a)"""

_STRUCT = r"""least(1::DOUBLE, (CASE WHEN starts_with(text, '#') OR (regexp_matches(text, '^\p{Lu}') AND ends_with(text, ':')) THEN 0.3::DOUBLE ELSE 0 END)
 + (CASE WHEN starts_with(text, '- ') OR starts_with(text, '* ') OR regexp_matches(text, '^\p{N}') THEN 0.2::DOUBLE ELSE 0 END)
 + (CASE WHEN contains(text, '?') THEN 0.1::DOUBLE ELSE 0 END)
 + (CASE WHEN starts_with(text, '```') OR starts_with(text, '    ') OR contains(text, 'fn ') OR contains(text, 'def ') THEN 0.2::DOUBLE ELSE 0 END)
 + (CASE WHEN regexp_matches(lower(text), 'important|note|warning|todo|fixme|critical|key|summary') THEN 0.1::DOUBLE ELSE 0 END))"""


def _analysis(budget: str) -> str:
    """Everything up to ``marked``: scores, flags, importance and a budget for each segment."""
    return f"""{_SEG}, {_freq("seg")}, {_TFIDF}, {_SETS}, {_pairs_sql(0.85)}, {_CLUSTERS},
counted AS (SELECT seg.*, {_approx("text")} AS tokens, {_boiler("text")} AS boilerplate_score FROM seg),
totals AS (SELECT ctx_id, count(*) AS n, sum(tokens)::BIGINT AS total FROM counted GROUP BY 1),
budgets AS (SELECT doc_id AS ctx_id, {budget} AS budget FROM documents),
early AS (SELECT c.*, t.n, t.total, b.budget, coalesce(f.tfidf_score, 0) AS tfidf_score, k.component,
  coalesce(f.tfidf_score, 0) * (CASE WHEN c.seg_idx::DOUBLE / n < 0.1::DOUBLE OR c.seg_idx::DOUBLE / n > 0.9::DOUBLE THEN 1 ELSE 0.95::DOUBLE END) AS importance0, c.boilerplate_score >= 0.9::DOUBLE AS is_boilerplate
  FROM counted c JOIN totals t ON c.ctx_id = t.ctx_id JOIN budgets b ON c.ctx_id = b.ctx_id LEFT JOIN tfidf f ON c.ctx_id = f.ctx_id AND c.seg_idx = f.seg_idx
  JOIN clusters k ON c.ctx_id = k.ctx_id AND c.seg_idx = k.seg_idx),
judged AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, component ORDER BY importance0 DESC, seg_idx) > 1 AS is_redundant FROM early),
marked AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN is_redundant THEN 0::DOUBLE ELSE (0.3::DOUBLE * pow(0.95::DOUBLE, seg_idx::DOUBLE / n::DOUBLE * 10) + 0.4::DOUBLE * tfidf_score + 0.2::DOUBLE * {_STRUCT}
  + (CASE WHEN tokens < 10 THEN -0.1::DOUBLE WHEN tokens > 500 THEN -0.05::DOUBLE ELSE 0 END)) * (CASE WHEN is_boilerplate THEN 0.1::DOUBLE ELSE 1 END) END)) AS importance_score FROM judged)"""


def _fold(where: str, score_col: str, room: str) -> str:
    """First fit over ``marked`` rows with ``where``, by score, under ``room``."""
    return f"""
ranked AS (SELECT ctx_id, seg_idx, tokens, {room} AS room, row_number() OVER (PARTITION BY ctx_id ORDER BY round({score_col}, 9) DESC, seg_idx) AS r FROM marked WHERE {where}),
fold AS (SELECT ctx_id, seg_idx, r, CASE WHEN tokens <= room THEN tokens ELSE 0 END AS used, tokens <= room AS taken FROM ranked WHERE r = 1
  UNION ALL SELECT k.ctx_id, k.seg_idx, k.r, f.used + CASE WHEN f.used + k.tokens <= k.room THEN k.tokens ELSE 0 END, f.used + k.tokens <= k.room FROM fold f JOIN ranked k ON k.ctx_id = f.ctx_id AND k.r = f.r + 1),
chosen AS (SELECT ctx_id, seg_idx FROM fold WHERE taken)"""


_HALF = f"ceil({_approx('text')} * 0.5::DOUBLE)::BIGINT"
_EXTRACTIVE = _fold("importance_score > 0.3::DOUBLE AND budget > 0", "importance_score", "budget")


def _done(budget: str) -> str:
    """Everything up to ``outcome`` and ``stats`` of a compression under ``budget``."""
    return f"""WITH RECURSIVE {_analysis(budget)}, {_fold("importance_score > 0.3::DOUBLE AND budget > 0 AND total > budget", "importance_score", "budget")},
final AS (SELECT m.*, c.seg_idx IS NOT NULL AS selected FROM marked m LEFT JOIN chosen c ON m.ctx_id = c.ctx_id AND m.seg_idx = c.seg_idx WHERE total > budget),
told AS (SELECT ctx_id, sum(CASE WHEN selected THEN tokens ELSE 0 END)::BIGINT AS c, count(*) FILTER (selected) AS k, sum(CASE WHEN is_redundant THEN tokens ELSE 0 END)::BIGINT AS r,
  sum(CASE WHEN is_boilerplate THEN tokens ELSE 0 END)::BIGINT AS b, string_agg(text, chr(10) || chr(10) ORDER BY seg_idx) FILTER (selected) AS o FROM final GROUP BY 1),
outcome AS (SELECT d.doc_id AS ctx_id, d.text, d.lang, d.source, t.n, t.total, s.*, CASE WHEN trim(d.text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 'empty_input' WHEN t.n IS NULL THEN 'no_segments'
  WHEN t.total <= bb.budget THEN 'pass_through' ELSE 'compressed' END AS status FROM documents d JOIN budgets bb ON d.doc_id = bb.ctx_id LEFT JOIN totals t ON d.doc_id = t.ctx_id LEFT JOIN (SELECT ctx_id AS x, c, k, r, b, o FROM told) s ON d.doc_id = s.x),
counts AS (SELECT ctx_id, lang, source, CASE WHEN n IS NULL THEN CASE WHEN status = 'no_segments' THEN {_approx("text")} ELSE 0 END ELSE total END::BIGINT AS original_tokens,
  CASE WHEN status = 'compressed' THEN c WHEN n IS NULL THEN CASE WHEN status = 'no_segments' THEN {_approx("text")} ELSE 0 END ELSE total END::BIGINT AS compressed_tokens,
  CASE WHEN status = 'compressed' THEN r ELSE 0 END::BIGINT AS redundancy_removed, CASE WHEN status = 'compressed' THEN b ELSE 0 END::BIGINT AS boilerplate_removed,
  CASE WHEN status = 'compressed' THEN k ELSE coalesce(n, 0) END::BIGINT AS segments_kept, coalesce(n, 0)::BIGINT AS segments_total, status FROM outcome),
stats AS (SELECT *, CASE WHEN status = 'compressed' THEN greatest(0, greatest(0, greatest(0, original_tokens - redundancy_removed) - boilerplate_removed) - compressed_tokens) ELSE 0 END::BIGINT AS extractive_removed FROM counts)"""


_DONE, _DONE_DRESSED = _done(_HALF), _done("150::BIGINT")
_DERIVED = "greatest(0, original_tokens - compressed_tokens)::BIGINT AS tokens_saved, round(CASE WHEN original_tokens = 0 THEN 1 ELSE compressed_tokens::DOUBLE / original_tokens::DOUBLE END, 6) AS compression_ratio"
_COUNTS = ", ".join(stats.COUNTS)

_GAPS = f"""gaps AS (SELECT ctx_id, seg_idx, text, lag(seg_idx) OVER (PARTITION BY ctx_id ORDER BY seg_idx) AS before FROM final WHERE selected),
told_kinds AS (SELECT ctx_id, seg_idx, text, unnest(list_filter([CASE WHEN regexp_matches(text, {_quoted(ORPHANED_PRONOUN)}) THEN 'orphaned pronoun' END, CASE WHEN regexp_matches(text, {_quoted(DANGLING_REFERENCE)}) THEN 'dangling reference' END,
  CASE WHEN regexp_matches(text, {_quoted(INCOMPLETE_LIST)}) THEN 'incomplete list' END, CASE WHEN regexp_matches(text, {_quoted(DANGLING_REFERENCE)}) OR regexp_matches(text, {_quoted(CODE_REFERENCE)}) THEN 'orphaned code reference' END], lambda x: x IS NOT NULL)) AS kind
  FROM gaps WHERE seg_idx > coalesce(before + 1, 0)),
cut_to AS (SELECT *, list_max(list_filter(range(0, 51), lambda k: strlen(left(text, k::BIGINT)) <= 50)) AS k FROM told_kinds)"""

_MD = r"""
parts AS (SELECT doc_id AS ctx_id, string_split(text, chr(10)) AS l FROM documents),
md AS (SELECT ctx_id, '# ' || l[1] || chr(10) || chr(10) || array_to_string(l[2:], chr(10) || chr(10)) || chr(10) || '```text' || chr(10) || l[-1] || chr(10) || '```' || chr(10) || '## End' || chr(10) || 'last words here' || chr(10) AS text FROM parts)"""


def _semantic_sql(source: str, compat: str) -> str:
    """The rules of semantic mode as a machine that reads a line a step: ``state`` after the line, ``own`` (new, same, span, none) for the line."""
    return rf"""WITH RECURSIVE {source},
raw AS (SELECT ctx_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS n FROM md),
lines AS (SELECT ctx_id, k, regexp_replace(r, '\r$', '') AS line, regexp_replace(r, '^\s+|\s+$', '', 'g') AS t, strlen(r) + 1 AS width,
  coalesce(sum(strlen(r) + 1) OVER (PARTITION BY ctx_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM raw WHERE k < n OR r <> ''),
kinds AS (SELECT *, CASE WHEN starts_with(t, '```') THEN 'fence' WHEN regexp_matches(t, '^#{{1,6}} ') THEN 'head' WHEN t = '' THEN 'blank' ELSE 'text' END AS kind FROM lines),
walk AS (SELECT ctx_id, 0 AS k, 'top' AS state, 'none' AS own FROM md UNION ALL
  SELECT w.ctx_id, x.k::INTEGER, CASE WHEN w.state = 'skip' THEN 'top' WHEN w.state = 'fence' THEN CASE WHEN kind = 'fence' THEN 'top' ELSE 'fence' END WHEN kind = 'fence' THEN 'fence' WHEN kind = 'head' THEN 'section'
    WHEN w.state = 'section' THEN 'section' WHEN kind = 'text' THEN 'para' WHEN w.state = 'para' THEN 'top' ELSE '{"top" if compat == "fixed" else "skip"}' END,
  CASE WHEN w.state = 'skip' THEN 'none' WHEN w.state = 'fence' THEN 'same' WHEN kind IN ('fence', 'head') THEN 'new' WHEN w.state = 'section' THEN 'same'
    WHEN kind = 'text' THEN CASE WHEN w.state = 'para' THEN 'same' ELSE 'new' END WHEN w.state = 'para' THEN 'span' ELSE 'none' END
  FROM walk w JOIN kinds x ON w.ctx_id = x.ctx_id AND x.k = w.k + 1),
owned AS (SELECT x.*, w.own, sum(CASE WHEN w.own = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY x.ctx_id ORDER BY x.k) AS seg FROM kinds x JOIN walk w ON x.ctx_id = w.ctx_id AND x.k = w.k),
built AS (SELECT ctx_id, seg, string_agg(line || chr(10), '' ORDER BY k) FILTER (own IN ('new', 'same')) AS body, min(off) AS "start", max(off + width)::BIGINT AS "end", max(CASE WHEN own = 'new' THEN kind END) = 'fence' AS is_code_block,
  max(CASE WHEN own = 'new' AND kind = 'head' THEN length(regexp_extract(t, '^(#+) ', 1)) ELSE 0 END)::INTEGER AS heading_level FROM owned WHERE own <> 'none' GROUP BY 1, 2),
clean AS (SELECT *, regexp_replace(CASE WHEN is_code_block THEN body ELSE regexp_replace(body, '^\s+', '') END, '\s+$', '') AS text FROM built)
SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY "start") - 1)::INTEGER AS seg_idx, text, "start", "end", is_code_block, heading_level FROM clean WHERE strlen(CASE WHEN is_code_block THEN body ELSE text END) >= 10"""


_PARAGRAPHS = r"""
placed AS (SELECT ctx_id, n, base, pos, r, regexp_replace(r, '^\s+|\s+$', '', 'g') AS text, base + coalesce(sum(strlen(r) + 2) OVER (PARTITION BY ctx_id, n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT ctx_id, n, base, unnest(string_split(t, chr(10) || chr(10))) AS r, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS pos FROM between_blocks)),
paras AS (SELECT ctx_id, text, (off + strlen(regexp_extract(r, '^\s*')))::BIGINT AS "start", false AS is_code_block, length(regexp_extract(string_split(text, chr(10))[1], '^(#{1,6}) ', 1))::INTEGER AS heading_level FROM placed WHERE strlen(text) >= 10)"""
_BLOCK = r"'(?s)^(.*?)(```[^\n]*\n.*?\n```\n?)(.*)$'"
_CODE = rf"""WITH RECURSIVE {_MD},
peeled AS (SELECT ctx_id, 0 AS n, 0::BIGINT AS base, '' AS t, '' AS block, text AS rest FROM md UNION ALL
  SELECT ctx_id, n + 1, base + strlen(t) + strlen(block), regexp_extract(rest, {_BLOCK}, 1), regexp_extract(rest, {_BLOCK}, 2), regexp_extract(rest, {_BLOCK}, 3) FROM peeled WHERE regexp_matches(rest, {_BLOCK})),
between_blocks AS (SELECT ctx_id, n, base, t FROM peeled UNION ALL SELECT ctx_id, n + 1, base + strlen(t) + strlen(block), rest FROM peeled QUALIFY row_number() OVER (PARTITION BY ctx_id ORDER BY n DESC) = 1), {_PARAGRAPHS},
both_kinds AS (SELECT ctx_id, text, "start", ("start" + strlen(text))::BIGINT AS "end", is_code_block, heading_level FROM paras
  UNION ALL SELECT ctx_id, block, base + strlen(t), base + strlen(t) + strlen(block), true, 0 FROM peeled WHERE strlen(block) >= 10)
SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY "start") - 1)::INTEGER AS seg_idx, text, "start", "end", is_code_block, heading_level FROM both_kinds"""

_LARGE = r"""WITH RECURSIVE long AS (SELECT doc_id AS ctx_id, regexp_replace(regexp_replace(concat_ws(' ', text, text, text), '\n+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t,
  strlen(regexp_extract(regexp_replace(concat_ws(' ', text, text, text), '\n+', ' ', 'g'), '^\s*')) AS led FROM documents),
words AS (SELECT ctx_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS k FROM long WHERE strlen(t) > 10000),
ends AS (SELECT ctx_id, k, w, sum(strlen(w) + 1) OVER (PARTITION BY ctx_id ORDER BY k) AS b FROM words),
stops AS (SELECT e.ctx_id, b, ends_with(w, '.') AS dot, coalesce(min(CASE WHEN w <> '' THEN b - strlen(w) - 1 END) OVER (PARTITION BY e.ctx_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b) AS nxt FROM ends e),
cuts AS (SELECT ctx_id, 0 AS i, 0::BIGINT AS pos, 0::BIGINT AS place, NULL::BIGINT AS b FROM long WHERE strlen(t) > 10000
  UNION ALL SELECT c.ctx_id, c.i + 1, s.nxt::BIGINT, c.place + (s.b - c.pos)::BIGINT, s.b::BIGINT FROM cuts c JOIN long l ON c.ctx_id = l.ctx_id JOIN stops s ON s.ctx_id = c.ctx_id AND s.b > c.pos AND s.b <= c.pos + 10000
  WHERE strlen(l.t) - c.pos > 10000 QUALIFY row_number() OVER (PARTITION BY c.ctx_id ORDER BY s.dot DESC, s.b DESC) = 1),
pieces AS (SELECT a.ctx_id, a.i, a.pos, a.place, coalesce(b.b, strlen(l.t)) AS b, b.b IS NULL AS last FROM cuts a JOIN long l ON a.ctx_id = l.ctx_id LEFT JOIN cuts b ON a.ctx_id = b.ctx_id AND b.i = a.i + 1),
texts AS (SELECT p.ctx_id, p.i, p.place, p.b - p.pos AS n, last, (SELECT string_agg(e.w, ' ' ORDER BY e.k) FROM ends e WHERE e.ctx_id = p.ctx_id AND e.b > p.pos AND e.b <= p.b + CASE WHEN last THEN 1 ELSE 0 END) || CASE WHEN last THEN '' ELSE ' ' END AS text FROM pieces p),
all_segments AS (SELECT ctx_id, i, text, place + led AS "start", place + led + n AS "end", last FROM texts JOIN long USING (ctx_id) UNION ALL SELECT ctx_id, 0, t, led, led + strlen(t), true FROM long WHERE strlen(t) <= 10000)
SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY i) - 1)::INTEGER AS seg_idx, text, "start"::BIGINT AS "start", "end"::BIGINT AS "end", false AS is_code_block, 0::INTEGER AS heading_level FROM all_segments WHERE NOT last OR strlen(text) >= 10"""

_SENTENCE = r"""WITH marked AS (SELECT doc_id AS ctx_id, regexp_replace(text, '([.!?]+["'')”»]*[ \t]*\n?|\n)', '\1' || chr(1), 'g') AS t FROM documents),
raw AS (SELECT ctx_id, unnest(string_split(t, chr(1))) AS r, generate_subscripts(string_split(t, chr(1)), 1) AS k FROM marked),
beside AS (SELECT *, lag(r) OVER (PARTITION BY ctx_id ORDER BY k) AS before FROM raw WHERE r <> ''),
joined AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND NOT ends_with(before, chr(10)) AND (regexp_matches(r, '^[,;:-]') OR regexp_matches(before, '\.["'')”»]*[ \t]*$') AND (regexp_matches(r, '^[^\p{L}\n.!?]*\p{Ll}')
  OR ends_with(before, '.') AND regexp_matches(r, '^[\p{N}\p{Lu}]'))) THEN 0 ELSE 1 END) OVER (PARTITION BY ctx_id ORDER BY k) AS s FROM beside),
whole AS (SELECT ctx_id, s, string_agg(r, '' ORDER BY k) AS r FROM joined GROUP BY 1, 2),
placed AS (SELECT ctx_id, s, regexp_replace(r, '^\s+|\s+$', '', 'g') AS text, coalesce(sum(strlen(r)) OVER (PARTITION BY ctx_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(regexp_extract(r, '^\s*')) AS place FROM whole)
SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY s) - 1)::INTEGER AS seg_idx, text, place::BIGINT AS "start", (place + strlen(text))::BIGINT AS "end", false AS is_code_block, 0::INTEGER AS heading_level FROM placed WHERE strlen(text) >= 10"""


def _dress_sql(sql: str) -> str:
    """The same SQL on dressed documents."""
    starts = ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in DRESS)
    lines = f"list_transform(string_split(text, chr(10)), lambda x, i: ([{starts}])[(i - 1) % {len(DRESS)} + 1] || x)"
    body = re.sub(r"^\s*WITH (RECURSIVE )?", "", re.sub(r"\bdocuments\b", "dressed", sql))
    return f"WITH RECURSIVE dressed AS (SELECT doc_id, lang, source, array_to_string({lines}, chr(10)) AS text FROM documents), {body}"


_REPORT = (
    "printf('Compression Statistics\n======================\n\nOriginal tokens:    %8d\nCompressed tokens:  %8d\nTokens saved:       %8d\nCompression ratio:  %7.1f%%\n\nBreakdown:\n"
    "  Redundancy removed: %6d\n  Boilerplate removed:%6d\n  Extractive removed: %6d\n\nSegments: %d/%d kept\n', original_tokens, compressed_tokens, tokens_saved, ratio * 100, redundancy_removed, boilerplate_removed, extractive_removed, segments_kept, segments_total)"
)
_JSON = (
    """printf('{"original_tokens":%d,"compressed_tokens":%d,"tokens_saved":%d,"compression_ratio":%.4f,"redundancy_removed":%d,"boilerplate_removed":%d,"extractive_removed":%d,"segments_kept":%d,"segments_total":%d}', """
    "original_tokens, compressed_tokens, tokens_saved, ratio, redundancy_removed, boilerplate_removed, extractive_removed, segments_kept, segments_total)"
)
_TOLD = "(SELECT *, greatest(0, original_tokens - compressed_tokens)::BIGINT AS tokens_saved, CASE WHEN original_tokens = 0 THEN 1 ELSE compressed_tokens::DOUBLE / original_tokens::DOUBLE END AS ratio FROM stats)"
_WARNED = "SELECT ctx_id, seg_idx, kind, left(text, k::BIGINT) AS preview FROM cut_to"
_OUTPUT = "SELECT ctx_id, CASE WHEN status IN ('pass_through', 'no_segments') THEN text WHEN status = 'compressed' THEN coalesce(o, '') END AS output, status FROM outcome"

ORACLE_SQL = {
    "seg_line": f"WITH {_SEG} SELECT * FROM seg",
    "seg_paragraph_conv": r"""WITH conv AS (SELECT conv_id AS ctx_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1),
raw AS (SELECT ctx_id, unnest(string_split(text, chr(10) || chr(10))) AS r, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM conv),
placed AS (SELECT ctx_id, pos, r, regexp_replace(r, '^\s+|\s+$', '', 'g') AS text, coalesce(sum(strlen(r) + 2) OVER (PARTITION BY ctx_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM raw),
spaced AS (SELECT *, (off + strlen(regexp_extract(r, '^\s*')))::BIGINT AS "start" FROM placed WHERE strlen(text) >= 10)
SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY pos) - 1)::INTEGER AS seg_idx, text, "start", ("start" + strlen(text))::BIGINT AS "end", length(regexp_extract(string_split(text, chr(10))[1], '^(#{1,6}) ', 1))::INTEGER AS heading_level FROM spaced""",
    "tokens_approx": f"WITH {_SEG} SELECT ctx_id, seg_idx, {_approx('text')} AS tokens FROM seg",
    "tokens_wordchar": f"WITH {_SEG} SELECT ctx_id, seg_idx, greatest({_approx('text')}, length(text) // 4)::BIGINT AS tokens FROM seg",
    "budget_percent": f"SELECT doc_id AS ctx_id, {_approx('text')} AS whole, ceil({_approx('text')} * 0.07::DOUBLE)::BIGINT AS budget FROM documents",
    "budget_model": "WITH models(model, w) AS (VALUES " + ", ".join(f"('{m}', {w})" for m, w in MODELS.items()) + f"), usage AS (SELECT max({_approx('text')}) AS largest FROM documents) SELECT model, (w - 4000)::BIGINT AS budget, largest <= w - 4000 AS all_fit FROM models, usage",
    "term_freq": f"WITH {_SEG}, {_freq('seg')} SELECT * FROM freq",
    "doc_freq": f"WITH {_SEG}, {_freq('seg')} SELECT ctx_id, term, count(*) AS df FROM freq GROUP BY 1, 2",
    "tfidf_score": f"WITH {_SEG}, {_freq('seg')}, {_TFIDF} SELECT ctx_id, seg_idx, round(tfidf_score, 6) AS tfidf_score FROM tfidf",
    "tfidf_foreign": f"""WITH items AS (SELECT 0::BIGINT AS ctx_id, item_id::INTEGER AS seg_idx, text FROM benchmark), {_freq("items")},
dfs AS (SELECT term, count(*) AS df FROM freq WHERE seg_idx % 2 = 0 GROUP BY 1), size AS (SELECT count(*) AS n FROM items WHERE seg_idx % 2 = 0),
mine AS (SELECT f.*, coalesce(df, 0) AS df, n, max(tf) OVER (PARTITION BY seg_idx) AS top FROM freq f LEFT JOIN dfs ON f.term = dfs.term, size WHERE seg_idx % 2 = 1)
SELECT ctx_id, seg_idx, round(sum((0.5::DOUBLE + 0.5::DOUBLE * (tf::DOUBLE / top::DOUBLE)) * (ln((n + 1)::DOUBLE / (df + 1)::DOUBLE) + 1) ORDER BY term) / sqrt(count(*)::DOUBLE), 6) AS tfidf_score FROM mine GROUP BY 1, 2""",
    "boilerplate_score": f"WITH {_SEG}, b AS (SELECT ctx_id, seg_idx, {_boiler('text', (USER_RULE,))} AS boilerplate_score FROM seg) SELECT * FROM b WHERE boilerplate_score > 0",
    "boilerplate_flag": f"WITH {_SEG}, b AS (SELECT ctx_id, count(*) FILTER ({_boiler('text', (USER_RULE,))} >= 0.8::DOUBLE) AS flagged, count(*) AS segments FROM seg GROUP BY 1) SELECT * FROM b WHERE flagged > 0",
    "shingles": f"WITH {_SEG}, {_SETS} SELECT ctx_id, seg_idx, len(s)::INTEGER AS n_shingles, len(list_distinct(s))::INTEGER AS n_distinct, array_to_string(s, '|') AS shingles FROM shs",
    "dup_classes": f"WITH {_SEG}, {_SETS} SELECT ctx_id, seg_idx, rep FROM classes",
    "jaccard_pairs": f"WITH {_SEG}, {_SETS}, {_pairs_sql(0.5)} SELECT ctx_id, i, j, round(similarity, 6) AS similarity FROM pairs",
    "dup_clusters": f"WITH RECURSIVE {_SEG}, {_SETS}, {_pairs_sql(0.5)}, {_CLUSTERS} SELECT * FROM clusters",
    "dup_representatives": f"WITH RECURSIVE {_SEG}, {_SETS}, {_pairs_sql(0.5)}, {_CLUSTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, component ORDER BY seg_idx % 7 DESC, seg_idx) AS r FROM clusters) SELECT ctx_id, component, seg_idx AS rep_idx FROM o WHERE r = 1",
    "position_decay": f"WITH {_SEG}, s AS (SELECT *, count(*) OVER (PARTITION BY ctx_id) AS n FROM seg) SELECT ctx_id, seg_idx, CASE WHEN seg_idx::DOUBLE / n < 0.1::DOUBLE OR seg_idx::DOUBLE / n > 0.9::DOUBLE THEN 1::DOUBLE ELSE 0.95::DOUBLE END AS factor, round(pow(0.95::DOUBLE, seg_idx::DOUBLE / n * 10), 6) AS weight FROM s",
    "structural_weight": f"WITH {_SEG} SELECT ctx_id, seg_idx, round({_STRUCT}, 6) AS structural FROM seg",
    "importance": f"WITH RECURSIVE {_analysis(_HALF)} SELECT ctx_id, seg_idx, tokens, is_boilerplate, is_redundant, round(importance0, 6) AS importance0, round(importance_score, 6) AS importance_score FROM marked",
    "select_extractive": f"WITH RECURSIVE {_analysis(_HALF)}, {_EXTRACTIVE} SELECT * FROM chosen",
    "select_fit": f"WITH RECURSIVE {_analysis(_HALF)}, {_fold('NOT is_redundant AND NOT is_boilerplate', 'importance0', 'budget')} SELECT * FROM chosen",
    "select_preserves": f"""WITH RECURSIVE {_analysis("400::BIGINT").replace("marked AS (", "marked0 AS (")},
heads AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY ctx_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS h FROM marked0),
tails AS (SELECT *, h OR coalesce(sum(CASE WHEN h THEN 0 ELSE tokens END) OVER (PARTITION BY ctx_id ORDER BY seg_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 40 AS f FROM heads),
marked AS (SELECT *, greatest(0, budget - sum(CASE WHEN f THEN tokens ELSE 0 END) OVER (PARTITION BY ctx_id))::BIGINT AS left_over FROM tails), {_fold("NOT f AND NOT is_redundant AND NOT is_boilerplate", "importance0", "left_over")}
SELECT * FROM chosen UNION ALL SELECT ctx_id, seg_idx FROM marked WHERE f""",
    "compressed_output": f"{_DONE} {_OUTPUT}",
    "stats": f"{_DONE} SELECT ctx_id, {_COUNTS}, {_DERIVED} FROM stats",
    "stats_rollup": f"{_DONE}, rolled AS (SELECT lang, source, count(*) AS contexts, {', '.join(f'sum({c})::BIGINT AS {c}' for c in stats.COUNTS)} FROM stats GROUP BY ROLLUP (lang, source)) SELECT *, {_DERIVED} FROM rolled",
    "coherence_warnings": f"{_DONE}, {_GAPS} {_WARNED}",
    "stats_report": f"{_DONE} SELECT ctx_id, {_REPORT} AS report FROM {_TOLD}",
    "stats_json": f"{_DONE} SELECT ctx_id, {_JSON} AS json FROM {_TOLD}",
    "seg_large_split": _LARGE,
    "seg_semantic": _semantic_sql(_MD, "fixed"),
    "seg_semantic_reference": _semantic_sql(_MD, "reference"),
    "seg_code": _CODE,
    "seg_sentence": _SENTENCE,
    "boilerplate_dressed": _dress_sql(f"WITH {_SEG} SELECT ctx_id, seg_idx, heading_level, {_boiler('text')} AS boilerplate_score, {_boiler('text')} >= 0.9::DOUBLE AS flagged FROM seg"),
    "importance_dressed": _dress_sql(f"{_DONE_DRESSED} SELECT ctx_id, seg_idx, tokens, is_boilerplate, is_redundant, round(importance_score, 6) AS importance_score, selected FROM final"),
    "compressed_dressed": _dress_sql(f"{_DONE_DRESSED} {_OUTPUT}"),
    "stats_dressed": _dress_sql(f"{_DONE_DRESSED} SELECT ctx_id, {_COUNTS}, {_DERIVED} FROM stats"),
    "warnings_dressed": _dress_sql(f"{_DONE_DRESSED}, {_GAPS} {_WARNED}"),
    "budget_verified": _dress_sql(f"{_DONE_DRESSED} SELECT ctx_id, sum(CASE WHEN selected THEN tokens ELSE 0 END)::BIGINT AS used, budget, sum(CASE WHEN selected THEN tokens ELSE 0 END) <= budget AS within FROM final GROUP BY ctx_id, budget"),
    "redundancy": f"{_DONE} SELECT ctx_id, count(*) FILTER (is_redundant) AS redundant, coalesce(sum(tokens) FILTER (is_redundant), 0)::BIGINT AS redundant_tokens, coalesce(string_agg(seg_idx::VARCHAR, ',' ORDER BY seg_idx) FILTER (NOT is_redundant), '') AS unique FROM final GROUP BY ctx_id",
    "budget_model_column": "SELECT doc_id AS ctx_id, m AS model, (CASE m " + " ".join(f"WHEN '{m}' THEN {max(0, w - 8000)}" for m, w in MODELS.items()) + " ELSE 0 END)::BIGINT AS budget FROM (SELECT doc_id, (["
    + ", ".join(f"'{m}'" for m in [*MODELS, "unknown-model"]) + f"])[(doc_id % {len(MODELS) + 1} + 1)::INTEGER] AS m FROM documents)",
}

