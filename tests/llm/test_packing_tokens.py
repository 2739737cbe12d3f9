"""Token ids round trip; packing is exact, gapless and near the bound."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from textmill.llm import packing, tokens  # noqa: E402
from textmill.llm.common import shared_path  # noqa: E402

TEXTS = ["", " ", "a  b", "x \n y", "tab\t here", "<|endoftext|> hi", "trail ", "nbsp\xa0 x", "don't  you're 12 345 $$", "\n\nfoo bar.\nNext, line", " lead", "é x  y", "a\x1c b", "日本 語 text.", "Word, word. Word!\nWord?", None]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_tokenizer(), max_pieces=50)


def whole(encoder, t):
    return encoder.tok.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(encoder):
    for _ in range(3):  # the memory is emptied in between
        for t, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
            assert ids.tolist() == whole(encoder, t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1.,!' \n\té日$ ", max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    e = tokens.encoder(tokens.default_tokenizer())
    assert [x.tolist() for x in e.encode(texts)] == [whole(e, t) for t in texts]


def test_files_round_trip(spark):
    rows = [(i * 7 % 101, f"document {i} says\nhello " * (i % 5)) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = shared_path(spark, "ids")
    got = sorted(tokens.read_ids(spark, folder, *tokens.write_ids(docs, folder)).collect())
    at, e = 0, tokens.encoder(tokens.default_tokenizer())
    for (i, t), r in zip(sorted(rows), got, strict=True):
        ids = [*whole(e, t), 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(5, 2048) == [(0, 5)]
    assert packing.cut(4100, 2048) == [(0, 4), (4, 2048), (2052, 2048)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_plan_packs_everything(lengths):
    counts = Counter(lengths)
    plan = packing.plan(counts, 50)
    packed = Counter()
    for content, n in plan:
        assert sum(content) <= 50
        for x in content:
            packed[x] += n
    assert packed == counts
    bins = sum(n for _, n in plan)
    fitted = sum(n for _, n in packing.best_fit_decreasing(counts, 50))
    assert -(-sum(lengths) // 50) <= bins <= fitted


def test_branch_and_bound_beats_best_fit():
    # best-fit decreasing needs four sequences of 100
    counts = Counter([60, 50, 40, 30, 30, 20, 20, 50])
    assert sum(n for _, n in packing.plan(counts, 100)) == 3
    assert packing.branch_and_bound(Counter([6, 5, 5, 4]), 10, [(6,), (5,), (5,), (4,)]) in ([(6, 4), (5, 5)],)


def test_small_instances_are_optimal():
    def best(items, cap):
        if not items:
            return 0
        x, rest = items[0], items[1:]
        return 1 + min(best(tuple(rest[i] for i in range(len(rest)) if i not in c), cap) for k in range(len(rest) + 1) for c in combinations(range(len(rest)), k) if x + sum(rest[i] for i in c) <= cap)

    rng = np.random.default_rng(1)
    for _ in range(12):
        items = tuple(sorted(rng.integers(3, 20, 7).tolist(), reverse=True))
        assert sum(n for _, n in packing.plan(Counter(items), 30)) == best(items, 30)


def test_places_are_gapless_with_a_hot_length(spark):
    rows = [(i, "same words here") for i in range(400)] + [(1000 + i, "w " * (i % 300)) for i in range(100)] + [(5000, "long text " * 3000)]
    got = packing.place(packing.pieces(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows}
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
