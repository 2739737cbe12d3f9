"""Segmentation: native generators against the plain functions, and pins."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.operators import segment_text as S
from textmill.operators.segment import reassemble, segment

TEXTS = [
    "First paragraph here.\n\nSecond paragraph here.\n\nshort\n\n  Third one, indented.  ", "one line here\r\nanother line\r\n\r\nthird line ok\n", "a…bcdefgh\n\n\nb…cdefghij\n\nc", "", "  nbsp around text  \n\n\n\ntab\tinside text",
    "# Head of it\n\nbody text here\n## Sub head\nmore body text", ("word " * 3000).strip(), ("é" * 12_000), "x. " * 5000, "tiny",
]


def rows(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "ctx_id bigint, text string")
    got = segment(df, **options).orderBy("ctx_id", "seg_idx").collect()
    return [(r.ctx_id, r.seg_idx, r.text, r.start, r.end, r.is_code_block, r.heading_level) for r in got]


@pytest.mark.parametrize("mode", ["line", "paragraph"])
def test_native_modes_match_plain_ones(spark, mode):
    want = [(i, k, *p) for i, t in enumerate(TEXTS) for k, p in enumerate(S.MODES[mode](t))]
    assert rows(spark, TEXTS, mode=mode) == want


def test_offsets_point_at_the_text():
    for t in TEXTS[:6]:
        for text, a, b, _, _ in S.paragraphs(t) + S.sentences(t):
            assert t.encode()[a:b].decode() == text


def test_long_parts_are_cut_at_sentences_and_characters():
    assert all(len(x.encode()) <= 10_000 for t in TEXTS for x, *_ in S.paragraphs(t))
    assert S.cut_long("x. " * 5000)[0][0].endswith(". ")
    assert "".join(x for x, *_ in S.cut_long("é" * 12_000)) == "é" * 12_000


def test_semantic(spark):
    text = "# One\ntext under one\n\n## Two\ntext under two\n```py\ncode here = 1\n```\nafter the code\n\nlast paragraph"
    got = S.semantic(text)
    assert [p[0] for p in got] == ["# One\ntext under one", "## Two\ntext under two", "```py\ncode here = 1\n```", "after the code", "last paragraph"]
    assert [p[3] for p in got] == [False, False, True, False, False] and [p[4] for p in got] == [1, 2, 0, 0, 0]
    assert [r[2] for r in rows(spark, [text], mode="semantic")] == [p[0] for p in got]


def test_semantic_reference_loses_lines_after_blank_starts():
    text = "\n\n\nfirst paragraph\n\nsecond paragraph\n"
    assert [p[0] for p in S.semantic(text)] == ["first paragraph", "second paragraph"]
    assert S.semantic(text, "reference") == []  # every one-line paragraph from there on


def test_code_blocks(spark):
    text = "Intro words here.\n\nsee ```inline\nx = 1\n```\ntail paragraph here\n\n```unclosed"
    got = rows(spark, [text], mode="paragraph", preserve_code=True)
    assert [(r[2], r[5]) for r in got] == [("Intro words here.", False), ("```inline\nx = 1\n```\n", True), ("tail paragraph here", False), ("```unclosed", False)]
    assert S.code_blocks("```\n```") == [] and S.is_fenced_block("```\nabc\n```") and not S.is_fenced_block("``````")


def test_sentences():
    text = "Dr. Smith paid 3.50 dollars. He left! Did they? “Yes.” etc. and so on… Fin."
    assert [text[a:b].strip() for a, b in zip([0, *S.sentence_ends(text)], S.sentence_ends(text), strict=False)] == ["Dr.", "Smith paid 3.50 dollars.", "He left!", "Did they?", "“Yes.” etc. and so on… Fin."]
    assert S.sentence_ends("A b c. Next one. e.g. small\nline") == [7, 28, 32]  # a small letter goes on


def test_reassembly_is_in_order(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b")], "ctx_id bigint, seg_idx int, text string")
    assert reassemble(df).first().output == "a\n\nb\n\nc"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab #`\n\r.é", max_size=300))
def test_any_text_is_segmented(text):
    for compat in ("fixed", "reference"):
        S.semantic(text, compat)
    for mode in ("line", "paragraph"):
        for t, a, b, _, _ in S.with_code(text, mode):
            assert len(t.encode()) >= 10 and a <= b
    assert not text or S.sentence_ends(text)[-1] == len(text)
