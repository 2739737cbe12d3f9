"""Position, structure and importance of segments as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.rules import any_match
from textmill.functions.text import clamp

#: Words that make a segment count more, wherever they occur in it.
KEYWORDS = ("important", "note", "warning", "todo", "fixme", "critical", "key", "summary")


def position_factor(idx: Column, n: Column, decay: float) -> Column:
    """1 in the first and last tenth, else ``decay``."""
    at = idx.cast("double") / n.cast("double")
    return F.when((at < 0.1) | (at > 0.9), F.lit(1.0)).otherwise(F.lit(decay))


def position_weight(idx: Column, n: Column, decay: float) -> Column:
    """``decay`` to the power of ten times the relative position."""
    return F.pow(F.lit(float(decay)), idx.cast("double") / n.cast("double") * 10.0)


def structural_weight(text: Column) -> Column:
    """What headings, lists, questions, code and keywords add up to, at most 1."""
    low = F.lower(text)
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    total = (
        add(text.startswith("#") | (text.rlike(r"^\p{IsUppercase}") & text.endswith(":")), 0.3)
        + add(text.startswith("- ") | text.startswith("* ") | text.rlike(r"^\p{N}"), 0.2)
        + add(text.contains("?"), 0.1)
        + add(text.startswith("```") | text.startswith("    ") | text.contains("fn ") | text.contains("def "), 0.2)
        + add(low.rlike("|".join(KEYWORDS)), 0.1)
    )
    return F.least(total, F.lit(1.0))


def importance(
    idx: Column, n: Column, text: Column, tokens: Column, tfidf: Column, is_boilerplate: Column, is_redundant: Column, decay: float, preserve: tuple[str, ...] = ()
) -> Column:
    """Weighted sum of position, terms and structure, less for very short or long segments, cut to 0..1."""
    s = 0.3 * position_weight(idx, n, decay) + 0.4 * tfidf + 0.2 * structural_weight(text)
    s = s + F.when(tokens < 10, F.lit(-0.1)).when(tokens > 500, F.lit(-0.05)).otherwise(F.lit(0.0))
    if preserve:
        s = s + F.when(any_match(text, preserve), F.lit(0.2)).otherwise(F.lit(0.0))
    s = s * F.when(is_boilerplate, F.lit(0.1)).otherwise(F.lit(1.0))
    return clamp(F.when(is_redundant, F.lit(0.0)).otherwise(s))
