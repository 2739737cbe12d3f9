"""Terms, document frequencies and TF-IDF of segments within their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words without weight.
STOPWORDS = tuple(
    """a an the and or but in on at to for of with by from up about into over after is are was were be been being have has had do
    does did will would could should may might must shall can need dare ought used it its this that
    these those i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself they them their theirs themselves what which who whom when where why
    how all each every both few more most other some such no nor not only own same so than too very
    just also now here there then once if because as until while during before above below between
    under again further any s t d m ll re ve""".split()
)


def raw_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of more than one byte that are no stopwords."""
    parts = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOPWORDS))


def stem(w: Column) -> Column:
    """The first suffix that fits with enough bytes before it goes; lengths are in bytes, and all suffixes are ASCII.

    Fixed values: suffixes, least lengths and what replaces them.
    """
    n, chars = F.octet_length(w), F.length(w)
    without = lambda k: F.substring(w, F.lit(1), chars - k)
    ing = without(3)
    doubled = ing.endswith("ll") | ing.endswith("ss") | ing.endswith("zz")
    return (
        F.when(w.endswith("ing") & (n > 5), F.when(doubled, without(4)).otherwise(ing))
        .when((w.endswith("ed") | w.endswith("es")) & (n > 4), without(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), without(1))
        .when(w.endswith("ly") & (n > 4), without(2))
        .when(w.endswith("tion") & (n > 6), F.concat(without(4), F.lit("te")))
        .when(w.endswith("ness") & (n > 6), without(4))
        .otherwise(w)
    )


def term_freq(segments: DataFrame) -> DataFrame:
    """``ctx_id, seg_idx, term, tf``."""
    rows = segments.select("ctx_id", "seg_idx", F.explode(raw_terms(F.col("text"))).alias("w"))
    return rows.select("ctx_id", "seg_idx", stem(F.col("w")).alias("term")).groupBy("ctx_id", "seg_idx", "term").agg(F.count("*").alias("tf"))


def doc_freq(freq: DataFrame) -> DataFrame:
    """``ctx_id, term, df``: segments of the context that have the term."""
    return freq.groupBy("ctx_id", "term").agg(F.count("*").alias("df"))


def tfidf(segments: DataFrame) -> DataFrame:
    """``ctx_id, seg_idx, tfidf_score`` of segments that have terms. Summed in order of term, so shuffles can't move last digits."""
    n = F.count("*").over(W.partitionBy("ctx_id"))
    sized = segments.select("ctx_id", "seg_idx", "text", n.alias("n"))
    rows = sized.select("ctx_id", "seg_idx", "n", F.explode(raw_terms(F.col("text"))).alias("w"))
    freq = rows.select("ctx_id", "seg_idx", "n", stem(F.col("w")).alias("term")).groupBy("ctx_id", "seg_idx", "n", "term").agg(F.count("*").alias("tf"))
    freq = freq.withColumn("df", F.count("*").over(W.partitionBy("ctx_id", "term")))
    idf = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    per = freq.groupBy("ctx_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("term", "tf", idf.alias("idf")))).alias("ts"), F.max("tf").alias("top"))
    total = F.aggregate("ts", F.lit(0.0), lambda a, x: a + (0.5 + 0.5 * (x["tf"].cast("double") / F.col("top").cast("double"))) * x["idf"])
    return per.select("ctx_id", "seg_idx", (total / F.sqrt(F.size("ts").cast("double"))).alias("tfidf_score"))


def score_foreign(segments: DataFrame, freq: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Scores segments against statistics of other texts: ``freq`` is ``ctx_id, term, df``, ``n_docs`` is ``ctx_id, n``; unknown terms have df 0."""
    mine = term_freq(segments).join(freq, ["ctx_id", "term"], "left").join(n_docs, "ctx_id")
    df = F.coalesce("df", F.lit(0))
    idf = F.when(df == 0, F.log(F.col("n") + 1.0) + 1.0).otherwise(F.log((F.col("n") + 1.0) / (df + 1.0)) + 1.0)
    per = mine.groupBy("ctx_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("term", "tf", idf.alias("idf")))).alias("ts"), F.max("tf").alias("top"))
    total = F.aggregate("ts", F.lit(0.0), lambda a, x: a + (0.5 + 0.5 * (x["tf"].cast("double") / F.col("top").cast("double"))) * x["idf"])
    return per.select("ctx_id", "seg_idx", (total / F.sqrt(F.size("ts").cast("double"))).alias("tfidf_score"))
