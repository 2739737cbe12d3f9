"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three patterns: assignments, access keys, long hexadecimal runs. The battery adds spans of kind
``random``: runs of 16 or more characters of ``[A-Za-z0-9+/_-]`` (with ``=`` padding) outside base spans. For each the
smallest of a list of encodings that holds all its characters is inferred (digits, hexadecimal, base 32, base 36, base 62,
base 64), and three tests of the hypothesis that the characters are drawn evenly and independently are made over that
alphabet: chi-squared on alphabet use, runs above and below the middle of the alphabet, lag-one serial correlation.

A random string is one that these tests do not reject; but a short string is seldom rejected, so that alone is no
evidence. The evidence is how unlikely such evenness would be in ordinary text of the same length: the statistic's
distribution under letter frequencies of running text, by a normal approximation whose spread shrinks with length. These
p-values go through Benjamini-Hochberg over all candidates of a corpus, in strata of length (a long token's strong p-value
doesn't lend its threshold to short ones), from a histogram of bounded size: strata times bins, whatever the corpus.

Edge cases: null and empty texts have no spans; an empty table gives an empty table; repeated rows are scanned each by
itself; other columns are ignored by :func:`scan` and kept by :func:`redact`. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import col, fresh, materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ALPHABETS = (
    ("digits", string.digits),
    ("hex", string.digits + "abcdef"),
    ("hex", string.digits + "ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase),
    ("base36", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_letters),
    ("base64", string.digits + string.ascii_letters + "+/"),
    ("base64", string.digits + string.ascii_letters + "-_"),
)
#: Letters of running English text in 1000, a to z.
LETTERS = dict(zip(string.ascii_lowercase, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))
MIN_BITS = 72  # a secret worth the name
REJECT = 0.001  # each test of the battery, before its share
BINS, STRATA = 64, (16, 20, 24, 32, 40, 48, 64, 96, 128)

SCAN = T.StructType([
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("stratum", T.IntegerType()), T.StructField("bin", T.IntegerType())]))),
])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom > x), by Wilson and Hilferty."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> tuple[str, str] | None:
    """Name and characters of the smallest alphabet that holds the token."""
    have = set(token)
    return next(((name, chars) for name, chars in ALPHABETS if have <= set(chars)), None)


def battery(token: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of chi-squared, runs and serial correlation for even, independent draws from ``alphabet``."""
    n, k = len(token), len(alphabet)
    v = np.array([alphabet.index(c) for c in token], dtype=float)
    counts = np.bincount(v.astype(int), minlength=k)
    p_chi = _chi_tail(float(((counts - n / k) ** 2).sum() * k / n), k - 1)
    high = v >= k / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = v - v.mean()
    ss = float((d * d).sum())
    p_serial = _two_sided((float((d[1:] * d[:-1]).sum()) / ss + 1 / n) * math.sqrt(n)) if ss else 0.0
    return p_chi, p_runs, p_serial


def text_p(token: str, alphabet: str) -> float:
    """How often running text of this length would be as evenly spread over the alphabet as the token is, or more."""
    n, k = len(token), len(alphabet)
    letters = [c for c in alphabet if c.lower() in LETTERS and (c.islower() or not any(x.islower() for x in alphabet))]
    if letters:
        q = np.array([LETTERS[c.lower()] for c in letters], dtype=float)
        q /= q.sum()
    else:
        q = np.array([1.0] * 4) / 4  # plain numbers: few digits in long repeats
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    # pairs of equal characters: their expected number and spread under text
    pairs = n * (n - 1) / 2
    mean = pairs * s2
    var = pairs * s2 * (1 - s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)
    counts = np.unique(list(token), return_counts=True)[1]
    seen = float((counts * (counts - 1) / 2).sum())
    spread = 0.5 * math.erfc((mean - seen) / math.sqrt(max(var, 1e-9)) / math.sqrt(2))
    mixed = sum((a.isdigit() != b.isdigit()) or (a.isupper() and b.islower()) or (a.islower() and b.isupper()) for a, b in zip(token, token[1:], strict=False))
    # text seldom changes between letters, digits and cases; one change in twelve is already generous
    lam = n / 12
    jumps = 1.0 if mixed <= lam else math.exp(mixed - lam + mixed * math.log(lam / mixed))  # Chernoff bound for Poisson
    return min(1.0, spread) * min(1.0, jumps)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(start, end, stratum, bin)`` of random-looking runs outside ``taken``; bin is the floor of minus log2 of the p-value."""
    out = []
    ends = [0]  # ends[k]: where the first k spans, by start, are all over
    for _, _, e in taken:
        ends.append(max(ends[-1], e))
    before = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while before < len(taken) and taken[before][1] < b:
            before += 1
        core = m.group().rstrip("=")
        if core.isalpha() and (core.islower() or core.isupper() or core.istitle()) or ends[before] > a:
            continue
        found = infer(core)
        if found is None:
            continue
        name, alphabet = found
        if name == "digits" or len(core) * math.log2(len(alphabet)) < MIN_BITS:
            continue
        if min(battery(core, alphabet)) * 3 < REJECT:
            continue
        p = max(text_p(core, alphabet), 2.0 ** -(BINS - 1))
        out.append((a, b, sum(len(core) >= x for x in STRATA) - 1, int(-math.log2(p))))
    return out


def _scan_udf():
    @F.pandas_udf(SCAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            spans, more = [], []
            for t in texts:
                s = base_spans(t) if t else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
                more.append([{"start": a, "end": b, "stratum": x, "bin": y} for a, b, x, y in (candidates(t, s) if t else [])])
            yield pd.DataFrame({"spans": spans, "candidates": more})

    return run.asNondeterministic()


def discoveries(histogram: dict[tuple[int, int], int], q: float = 0.01) -> dict[int, int]:
    """Benjamini-Hochberg in each stratum: the lowest bin that is still a discovery. A bin's p-value is its largest."""
    out = {}
    for stratum in {s for s, _ in histogram}:
        m = sum(n for (s, _), n in histogram.items() if s == stratum)
        passed, lowest = 0, None
        for b in range(BINS, -1, -1):
            passed += histogram.get((stratum, b), 0)
            if passed and 2.0**-b <= q * passed / m:
                lowest = b
        if lowest is not None:
            out[stratum] = lowest
    return out


def _decide(scanned: DataFrame, f: str, q: float) -> DataFrame:
    """Adds to the base spans in struct column ``f`` the candidates that survive false-discovery control, in order."""
    rows = scanned.select(F.explode(f"`{f}`.candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect()  # strata x bins
    lowest = discoveries({(r[0], r[1]): r[2] for r in rows}, q)
    ok = lambda c: F.lit(False) if not lowest else F.coalesce(*[F.when(c["stratum"] == s, c["bin"] >= b) for s, b in sorted(lowest.items())], F.lit(False))
    more = F.transform(F.filter(F.col(f"`{f}`.candidates"), ok), lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    order = lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    return scanned.withColumn(f, F.struct(F.col(f"`{f}`.spans").alias("base"), F.array_sort(F.transform(F.concat(F.col(f"`{f}`.spans"), more), order)).alias("spans")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.01) -> DataFrame:
    """``doc_id``, ``base`` (kind, start, end) and ``spans`` (all, by start, then kind) of every row."""
    rows = docs.select(col(id_col).alias("doc_id"), _scan_udf()(col(text_col)).alias("f"))
    return _decide(materialize(rows, "secrets"), "f", q).select("doc_id", "f.base", "f.spans")


def mask(text: str, spans: list, sign: str = "<secret>") -> str:
    """The text with spans, overlapping ones as one, replaced by ``sign``."""
    out, at = [], 0
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if a >= at:
            out += [text[at:a], sign]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", q: float = 0.01) -> DataFrame:
    """``docs`` with every span replaced by a sign, and ``count_col``, if there is one, counted again for these rows."""
    f = fresh(docs, "secrets")
    scanned = _decide(materialize(docs.withColumn(f, _scan_udf()(col(text_col))), "secret-rows"), f, q)

    @F.pandas_udf("string")
    def masked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([t if t is None or not len(s) else mask(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    hit = F.size(F.col(f"`{f}`.spans")) > 0
    g = fresh(docs, "masked")
    rows = scanned.where(~hit).withColumn(g, col(text_col)).unionByName(scanned.where(hit).withColumn(g, masked.asNondeterministic()(col(text_col), F.col(f"`{f}`.spans"))))
    change = {text_col: F.col(g)}
    if count_col in docs.columns:
        change[count_col] = F.when(F.size(F.col(f"`{f}`.spans")) > 0, F.length(F.col(g)).cast(docs.schema[count_col].dataType)).otherwise(col(count_col))
    return rows.select(*[change.get(c, col(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans that the query returns."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
