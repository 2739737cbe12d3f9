"""Token counts as columns, by name; more can be registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import n_words

_PER_WORD = 1.3


def approximate(text: Column) -> Column:
    """1.3 tokens a word, rounded up, at least one; none for the empty text."""
    count = F.greatest(F.lit(1), F.ceil(n_words(text) * F.lit(_PER_WORD).cast("double")))
    return F.when(text == "", F.lit(0)).otherwise(count).cast("bigint")


def word_char(text: Column) -> Column:
    """Like :func:`approximate`, but at least a token for every four characters."""
    by_words = F.ceil(n_words(text) * F.lit(_PER_WORD).cast("double"))
    count = F.greatest(F.lit(1).cast("bigint"), by_words, F.floor(F.length(text) / F.lit(4)))
    return F.when(text == "", F.lit(0)).otherwise(count).cast("bigint")


#: Fixed value: how byte-pair vocabularies of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def _encoding(rank_file: str | None, pattern: str | None):
    """This process's encoder. Without a rank file, the library's own vocabulary, which it may have to fetch."""
    key = (rank_file, pattern)
    if key not in _encodings:
        import base64

        import tiktoken

        if rank_file:
            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _encodings[key] = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            _encodings[key] = tiktoken.get_encoding("cl100k_base")
    return _encodings[key]


@lru_cache(maxsize=1)
def bpe_at_hand() -> bool:
    """Whether the library's own vocabulary can be had here: it is fetched once, which needs a network."""
    try:
        _encoding(None, None)
        return True
    except Exception:  # whatever the library or the network raises
        return False


def bpe(text: Column, rank_file: str | None = None, pattern: str | None = None) -> Column:
    """Length of the byte-pair encoding. ``rank_file`` and ``pattern`` name a vocabulary; the library's needs a network once."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            e = _encoding(rank_file, pattern)
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


_counters: dict[str, Callable[[Column], Column]] = {"approximate": approximate, "anthropic": word_char, "word_char": word_char, "openai": bpe, "bpe": bpe}


def register_tokenizer(name: str, counter: Callable[[Column], Column]) -> None:
    """Make ``counter`` available under ``name``."""
    _counters[name] = counter


def counter(name: str, vocabulary: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """The counter of that name; a vocabulary (rank file, and the pattern that splits before it) is for byte-pair counts."""
    if name not in _counters:
        raise ValueError(f"unknown tokenizer {name}; known: {', '.join(sorted(_counters))}")
    if vocabulary and _counters[name] is bpe:
        return lambda text: bpe(text, vocabulary, pattern or PATTERN)
    return _counters[name]
