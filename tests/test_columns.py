"""Column builders against known values."""

import pytest
from pyspark.sql import functions as F

from textmill.config import ArgumentError, Budget, BudgetError, ConfigError, Options, Thresholds, available, context_window, list_models, load, model_budget
from textmill.functions import rules, text, tokens
from textmill.operators import dedup, score, terms


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_token_counts(spark):
    assert values(spark, ["hello", " ".join(["w"] * 10), " ", "", "a b\tc"], tokens.approximate) == [2, 13, 1, 0, 4]
    assert values(spark, ["hello", "x" * 40, "", "ab"], tokens.word_char) == [2, 10, 0, 2]


def test_tokenizer_registry(spark):
    tokens.register_tokenizer("chars", lambda c: F.length(c).cast("bigint"))
    assert values(spark, ["abc"], tokens.counter("chars")) == [3]
    with pytest.raises(ValueError):
        tokens.counter("none such")


def test_bpe_from_rank_file(spark):
    public = pytest.importorskip("public_tokenizers")
    got = values(spark, ["hello world", "", None], lambda c: tokens.bpe(c, public.path("byte_bpe_50k.tiktoken"), public.PATTERN))
    assert got == [2, 0, 0]


def test_headings(spark):
    lines = ["# a", "###### six", "####### seven", "#NoSpace", "  ## indented", "plain", "# "]
    assert values(spark, lines, text.heading_level) == [1, 6, 0, 0, 2, 0, 0]


def test_trim_is_unicode(spark):
    assert values(spark, [" \t x \n", "\r\n"], text.utrim) == ["x", ""]


def test_stems(spark):
    words = ["running", "jumped", "cats", "class", "quickly", "nation", "relation", "kindness", "falling", "boxes", "es", "ring"]
    assert values(spark, words, terms.stem) == ["runn", "jump", "cat", "class", "quick", "nation", "relate", "kind", "fal", "box", "es", "ring"]


def test_stopwords_are_no_terms(spark):
    assert values(spark, ["the and of it's", "Über-cool x 42"], terms.raw_terms) == [[], ["über", "cool", "42"]]
    assert len(set(terms.STOPWORDS)) == 134


def test_boilerplate(spark):
    rows = ["MIT License\n\nCopyright", "copyright (c) 2024", "Auto-generated file", "x\nimport os", "-" * 30, "all rights reserved.", "see MIT License", "", "  ", "permission is hereby granted\nx the software", "©2020"]
    assert values(spark, rows, rules.boilerplate_score) == [0.95, 0.9, 0.95, 0.75, 0.9, 0.85, 0.0, 0.0, 0.0, 0.95, 0.9]
    assert values(spark, rows[4:5], lambda c: rules.boilerplate_score(c, (), False)) == [0.85]
    assert values(spark, ["Mine here"], lambda c: rules.boilerplate_score(c, ("^Mine",))) == [0.9]


def test_patterns_are_checked(spark):
    rules.check_patterns(spark, ("ok.*",))
    with pytest.raises(ConfigError):
        rules.check_patterns(spark, ("(",))


def test_structural_weight(spark):
    rows = ["# head", "Title:", "- item", "3 things", "why? not", "def f(x)", "a monkey", "plain"]
    assert [round(v, 6) for v in values(spark, rows, score.structural_weight)] == [0.3, 0.3, 0.2, 0.2, 0.1, 0.2, 0.1, 0.0]


def test_shingles(spark):
    rows = ["The quick brown fox", "one Two", "single", ""]
    assert values(spark, rows, dedup.shingles) == [["the quick brown", "quick brown fox"], ["one", "two", "one two"], ["single"], []]


def test_budgets():
    assert Budget.parse("25%").share == 0.25
    assert Budget.parse("100").tokens == 100
    for bad in ("abc", "0", "150%", "-5", "0%", ""):
        with pytest.raises(ConfigError):
            Budget.parse(bad)
    assert model_budget("GPT-4o", 4000) == 124_000
    assert context_window("none") is None and len(list_models()) == 8
    for model, reserve in (("none", 0), ("gpt-4", 8192)):
        with pytest.raises(BudgetError):
            model_budget(model, reserve)
    assert available(1000, 100, 100) == 800
    for args in ((100, 50, 60), (0, 0, 0)):
        with pytest.raises(ConfigError):
            available(*args)


def test_options(tmp_path):
    for bad in (Options(), Options(budget=Budget(tokens=5), aggressive=True, conservative=True), Options(budget=Budget(tokens=5, reserve=3))):
        with pytest.raises(ArgumentError):
            bad.check()
    with pytest.raises(ConfigError):
        Options(budget=Budget(tokens=5), thresholds=Thresholds(decay=1.5)).check()
    f = tmp_path / "c.toml"
    f.write_text('default_budget = "10%"\n[thresholds]\nredundancy_similarity = 0.5\n[strategies]\nredundancy = false\n[preserve_patterns]\na = "keep me"\n')
    o = load(str(f))
    assert o.thresholds.similarity == 0.5 and not o.redundancy and o.preserve_patterns == ("keep me",) and o.budget.share == 0.1
    with pytest.raises(ConfigError):
        load(str(tmp_path / "missing.toml"))
    assert load(str(tmp_path / "missing.toml"), Options(compat="reference")).thresholds == Thresholds()


def test_fixed_decimals_round_the_exact_value(spark):
    numbers = [a / b for b in range(1, 161) for a in range(b + 1)] + [0.00005, 0.00015, 0.99995, 12.34565, 2.5, 1e-12, 98765432.10985]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double").select("i", text.fixed(F.col("x") * 100.0, 1).alias("a"), text.fixed(F.col("x"), 4).alias("b"))
    assert [(r.a, r.b) for r in df.orderBy("i").collect()] == [(f"{x * 100:.1f}", f"{x:.4f}") for x in numbers]
