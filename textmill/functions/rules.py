"""Regular expressions in Java's dialect, set to behave alike everywhere: Unicode classes and case, ``\\n`` the only line end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import utrim

_FLAGS = "(?Uud)"
USER_CONFIDENCE = 0.90

#: Category, pattern, confidence.
BOILERPLATE = (
    ("license", r"(?i)^(MIT License|Apache License|GNU|BSD)", 0.95),
    ("copyright", r"(?i)^(Copyright \(c\)|©)", 0.90),
    ("generated", r"(?i)^(Auto-generated|DO NOT EDIT|Generated by)", 0.95),
    ("disclaimer", r"(?i)^(THE SOFTWARE IS PROVIDED|WITHOUT WARRANTY)", 0.90),
    ("separator", r"^[-=]{20,}\z", 0.85),
    ("import_block", r"(?m)^(import |from .+ import |require\(|use |#include )", 0.75),
    ("license_full", r"(?is)permission is hereby granted.*the software", 0.95),
    ("all_rights", r"(?i)all rights reserved", 0.85),
)
#: Rules that count a second time with the confidence of user rules; this lifts separators over the usual threshold.
AGAIN = ("license", "copyright", "generated", "disclaimer", "separator")

#: How a segment begins, or what it holds, that points to text before it.
ORPHANED_PRONOUN = r"(?i)^(he|she|it|they|this|that|these|those)\s"
DANGLING_REFERENCE = r"(?i)(as (mentioned|noted|described|discussed|shown|seen) (above|earlier|previously|before))"
INCOMPLETE_LIST = r"(?i)^(\d+\.|[-*•])\s"
CODE_REFERENCE = r"(?i)(the (above|following|below) (code|example|snippet|function|method))"


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs. In user patterns write ``\\z`` for the very end, as ``$`` also stands before a last line feed."""
    return text.rlike(_FLAGS + pattern)


def boilerplate_rules(extra: tuple[str, ...] = (), defaults_again: bool = True) -> list[tuple[str, float]]:
    rules = [(p, c) for _, p, c in BOILERPLATE]
    if defaults_again:
        rules += [(p, USER_CONFIDENCE) for name, p, _ in BOILERPLATE if name in AGAIN]
    return rules + [(p, USER_CONFIDENCE) for p in extra]


def boilerplate_score(text: Column, extra: tuple[str, ...] = (), defaults_again: bool = True) -> Column:
    """The highest confidence of a rule that matches; 0 for blank text. Rules are tried from the most confident down."""
    best: dict[str, float] = {}
    for p, c in boilerplate_rules(extra, defaults_again):
        best[p] = max(c, best.get(p, 0.0))
    by_confidence = sorted(best.items(), key=lambda x: -x[1])
    steps = [F.when(utrim(text) == "", F.lit(0.0))] + [F.when(matches(text, p), F.lit(c)) for p, c in by_confidence]
    return F.coalesce(*steps, F.lit(0.0)).cast("double")


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns], F.lit(False))


def check_patterns(spark, patterns: tuple[str, ...]) -> None:
    """Compile patterns once on the driver, in the dialect that the executors use."""
    from textmill.config import ConfigError

    for p in patterns:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(_FLAGS + p)
        except Exception as e:
            raise ConfigError(f"bad pattern {p!r}: {str(e).splitlines()[0]}") from None
