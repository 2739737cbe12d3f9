"""Column helpers with Unicode white space, byte lengths and line rules spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments are at least and at most so many bytes.
MIN_BYTES, MAX_BYTES = 10, 10_000


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` takes U+0020 only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def leading_bytes(c: Column) -> Column:
    """Bytes of white space at the start."""
    return F.octet_length(F.regexp_extract(c, r"(?U)^\s*", 0))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Words between Unicode white space, without a lambda: the pieces of the trimmed text."""
    t = utrim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+")))


def without_return(c: Column) -> Column:
    """A line without the one carriage return that may end it."""
    return F.regexp_replace(c, r"\r\z", "")


def heading_level(line: Column) -> Column:
    """1 to 6 for a trimmed line of so many ``#`` and a space, else 0."""
    return F.length(F.regexp_extract(utrim(line), r"^(#{1,6}) ", 1)).cast("tinyint")


def first_line(c: Column) -> Column:
    return without_return(F.substring_index(c, "\n", 1))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def less(a: Column, b: Column) -> Column:
    """Difference, but never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), a - b)


def fixed(c: Column, places: int) -> Column:
    """A number from 0 to 10^11 as text with 1 to 4 decimals: its exact binary value is rounded, ties to the even digit.

    ``format_string`` rounds the shortest decimal form instead, ties up. The error of the scaled product is found exactly: a
    float's 24 bits and the other 29 times the scale each fit a double.
    """
    scale = 10**places
    near, high = c * float(scale), c.cast("float").cast("double")
    error = (high * float(scale) - near) + (c - high) * float(scale)
    whole = F.floor(near)
    over = near - whole.cast("double") - 0.5
    up = (over > 0) | (over == 0) & ((error > 0) | (error == 0) & (whole % 2 == 1))
    digits = whole + F.when(up, 1).otherwise(0)
    return F.format_string(f"%d.%0{places}d", F.floor(digits / scale), digits % scale)
