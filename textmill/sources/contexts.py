"""Where contexts come from and where outputs go."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import InputError


def from_table(df: DataFrame, id_col: str, text_col: str = "text", *keep: str) -> DataFrame:
    """``ctx_id, text`` and the columns named, from any table."""
    return df.select(F.col(id_col).alias("ctx_id"), F.col(text_col).alias("text"), *keep)


def from_conversations(df: DataFrame) -> DataFrame:
    """One context for each conversation: turns in order, the speaker before each, blank lines between."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n\n")
    return df.groupBy(F.col("conv_id").alias("ctx_id")).agg(joined.alias("text"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One context for each text file; ``ctx_id`` is a hash of its path, kept as ``path``."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("ctx_id"), "text", "path")


def from_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "ctx_id bigint, text string")


def read_one(path: str | None) -> str:
    """A local file, or standard input, as text; errors name what is wrong."""
    try:
        if path is None:
            text = sys.stdin.buffer.read().decode("utf-8")
        elif not os.path.exists(path):
            raise InputError(f"no such file: {path}")
        else:
            with open(path, "rb") as f:
                text = f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise InputError(f"cannot read {path or 'standard input'}: {e}") from None
    if not text.strip():
        raise InputError("input is empty")
    return text


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a frame in any of Spark's formats; ``text`` takes the column ``output`` alone."""
    writer = (df.select("output") if kind == "text" else df).write.mode(mode)
    getattr(writer, kind)(path)
