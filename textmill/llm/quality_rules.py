"""Quality rules by weak supervision.

Rules look at a whole text and vote good, vote bad or abstain. How far each rule can be trusted is not set by hand:
expectation-maximisation over the counts of vote patterns estimates, for good and for bad documents, how often each rule
casts each vote; the posterior probability that a document is good then decides, instead of a demand that all rules agree.

Votes of ``k`` rules form one of ``3**k`` patterns, so what reaches the driver is a table of at most ``3**k`` counts at
any size of corpus, and every document takes part in the estimate.

Edge cases: a null or empty text has no words and all counts are zero; an empty table gives an empty table; repeated rows
are judged each by itself; columns other than the two named are ignored by :func:`features` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import col, fresh, materialize, words_of

#: Limits of the base rules of the query and of the voting rules: (bad beyond, good within).
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
RULES = ("length", "symbols", "dup_lines", "repeats", "capitals", "word_chars", "no_letter", "line_ends")
GOOD, BAD, ABSTAIN = 2, 0, 1
_SPACE = " \t\n\x0b\x0c\r"
_ENDS = tuple(".!?:;…\"”»)")

FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("votes", T.IntegerType())]
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in ``words``, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    acc = h[:n].copy()
    for j in range(1, window):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.sort(acc)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at: dict[tuple[bytes, ...], list[int]] = {}
    for i in np.flatnonzero(np.isin(acc, twice)).tolist():  # equal hashes are compared as words
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for starts in at.values():
        if len(starts) > 1:
            cover[starts] += 1
            np.subtract.at(cover, np.array(starts) + window, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _vote(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts of a text and the code of its vote pattern (base 3, first rule lowest)."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    spaces = sum(map(text.count, _SPACE))
    chars = len(text) - spaces
    symbols = sum(map(text.count, "#*$%&|<>"))
    dup, ended, seen = 0, 0, set()
    lines = 0
    for line in text.split("\n"):
        core = line.strip(_SPACE)
        if core:
            lines += 1
            ended += core.endswith(_ENDS)
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    spelled = text.split()
    capitals = sum(1 for w in spelled if len(w) > 1 and w.isupper())
    no_letter = sum(1 for w in spelled if not w.isalnum() and not any(map(str.isalpha, w)) or w.isdigit())
    m = max(n, 1)
    votes = (
        _vote(n, n < 20, n >= 40),
        _vote(symbols, symbols > 0.1 * m, symbols < 0.02 * m),
        _vote(dup, dup > 0.3 * max(lines, 1), dup == 0),
        _vote(repeats, repeats > 0.2 * m, repeats < 0.05 * m),
        _vote(capitals, capitals > 0.3 * m, capitals < 0.1 * m),
        _vote(chars, not 2.5 <= chars / m <= 14, 3.5 <= chars / m <= 11),
        _vote(no_letter, no_letter > 0.25 * m, no_letter < 0.05 * m),
        _vote(ended, 2 * ended < lines, ended >= 0.8 * lines),
    )
    code = 0
    for v in reversed(votes):
        code = code * 3 + v
    return n, chars, symbols, dup, repeats, code


def _measure_udf():
    @F.pandas_udf(FEATURES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=FEATURES.names)

    return run.asNondeterministic()  # else a later filter would run it twice


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the five counts and ``votes`` of every row, as a table in the shared folder."""
    out = docs.select(col(id_col).alias("doc_id"), _measure_udf()(col(text_col)).alias("f")).select("doc_id", "f.*")
    return materialize(out, "quality")


def _expand(codes: np.ndarray, k: int) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(k)) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, k: int = len(RULES), rounds: int = 200) -> dict[int, float]:
    """EM for two classes with a vote distribution for each rule and class; gives each pattern's posterior of good.

    Starts from the balance of votes, so that the class whose members get more good votes is the good one. Dirichlet
    smoothing keeps rare votes from certainty. An empty input gives an empty result.
    """
    if not len(codes):
        return {}
    votes = _expand(np.asarray(codes, dtype=np.int64), k)
    w = np.asarray(counts, dtype=float)
    one_hot = np.stack([votes == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    bad_votes = (votes == BAD).sum(1)
    post = np.where(bad_votes == 0, 0.95, np.where(bad_votes == 1, 0.3, 0.05))
    prior_good = np.array([0.2, 0.6, 1.2])
    for _ in range(rounds):
        g, b = w * post, w * (1 - post)
        pg = (np.einsum("p,pkv->kv", g, one_hot) + prior_good) / (g.sum() + prior_good.sum())
        pb = (np.einsum("p,pkv->kv", b, one_hot) + 0.7) / (b.sum() + 2.1)
        pg[:, BAD] = np.minimum(pg[:, BAD], pb[:, BAD])  # a bad vote never speaks for a document
        pg /= pg.sum(1, keepdims=True)
        prior = (g.sum() + 1) / (w.sum() + 2)
        logit = np.log(prior) - np.log1p(-prior) + np.einsum("pkv,kv->p", one_hot, np.log(pg) - np.log(pb))
        new = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return {int(c): float(p) for c, p in zip(codes, post, strict=True)}


def posteriors(measured: DataFrame, votes_col: str = "votes") -> DataFrame:
    """``(votes, p_good)`` for every pattern that occurs; at most ``3**len(RULES)`` rows, so a broadcast is bounded."""
    spark = measured.sparkSession
    rows = measured.groupBy(col(votes_col).alias("votes")).count().orderBy("votes").collect()  # at most 6561 rows
    table = estimate(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float))
    return spark.createDataFrame(list(table.items()), "votes int, p_good double")


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``p_good`` and ``kept`` to the rows of :func:`features`."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.join(F.broadcast(posteriors(measured)), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    )


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    f, v, p = (fresh(docs, f"quality{k}") for k in ("", "votes", "good"))
    kept_cols = [col(c) for c in docs.columns]
    measured = materialize(docs.withColumn(f, _measure_udf()(col(text_col))), "quality-rows")
    probs = posteriors(measured.select(f"{f}.votes"))
    probs = F.broadcast(probs.select(F.col("votes").alias(v), F.col("p_good").alias(p)))
    failed = (F.col(f"{f}.n_words") < 20) | (100 * F.col(f"{f}.n_repeat_words") > 30 * F.col(f"{f}.n_words"))
    good = measured.join(probs, F.col(f"{f}.votes") == F.col(v), "left")
    return good.where(~failed & (F.col(p) >= threshold)).select(*kept_cols)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(features(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )
