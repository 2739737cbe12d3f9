"""Awkward inputs for every operator, and connected components."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.llm import decontaminate, lang_id, lm_scoring, packing, quality_rules, secrets, simhash, substrings, tokens, url_filter
from textmill.llm.common import components, fresh, shared_path

SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, f string, votes int, kept boolean, component_id string, fp string, spans string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None), (2, "", "en", 0), (3, " \n\t ", "en", 4), (4, "one", "en", 3), (5, LONG, "en", len(LONG)), (6, "same text here twice over and again", "de", 35), (6, "same text here twice over and again", "de", 35),
    (7, "same text here twice over and again", None, 35), (None, "a row without an id but with some words", "en", 39), (8, "\u0000 odd ퟿ é 日本 \x1c\x85 text", "fr", 10),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True, "y", "z", "s") for r in rows], SCHEMA)


def apply(name, spark, docs):
    bench = spark.createDataFrame([(1, "nothing of this benchmark item occurs in any of the rows"), (2, None), (3, "")], "item_id bigint, text string")
    return {
        "packing": lambda: packing.place(packing.pieces(docs)),
        "url": lambda: url_filter.judge(docs, "doc_id", "text"),
        "simhash": lambda: simhash.classes(docs),
        "near": lambda: simhash.keep_one(docs),
        "tokens": lambda: tokens.read_ids(spark, *(lambda folder: (folder, *tokens.write_ids(docs, folder)))(shared_path(spark, "ids"))),
        "decontaminate": lambda: decontaminate.matches(docs, bench),
        "leaks": lambda: decontaminate.drop_leaks(docs, bench),
        "lang": lambda: lang_id.predict(docs),
        "substrings": lambda: substrings.dedup(docs),
        "quality": lambda: quality_rules.judge(quality_rules.features(docs)),
        "keep_good": lambda: quality_rules.keep_good(docs),
        "lm": lambda: lm_scoring.score(docs),
        "secrets": lambda: secrets.scan(docs),
        "redact": lambda: secrets.redact(docs),
    }[name]()


ALL = ("packing", "url", "simhash", "near", "tokens", "decontaminate", "leaks", "lang", "substrings", "quality", "keep_good", "lm", "secrets", "redact")


@pytest.mark.parametrize("name", ALL)
def test_awkward_rows(spark, name):
    got = apply(name, spark, table(spark, ROWS)).collect()
    if name in ("packing",):
        assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    elif name == "decontaminate":
        assert got == []
    elif name == "near":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 8), (True, 0)]
    elif name == "keep_good":
        assert {r.doc_id for r in got} <= {5}
    else:
        assert len(got) == len(ROWS)
    if name in ("near", "leaks", "keep_good", "redact"):
        assert got == [] or got[0].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert apply(name, spark, table(spark, [])).collect() == []


def test_components_match_a_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fresh_names(spark):
    assert fresh(spark.range(1).withColumn("__X", F.lit(1)), "x") == "__x1"
