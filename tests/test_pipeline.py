"""Selection, near-duplicates, coherence and the whole plan, against a plain model."""

import pytest
from pyspark.sql import functions as F

from textmill.cli import main
from textmill.config import Budget, ConfigError, Options
from textmill.operators import coherence, dedup, select, stats
from textmill.plans.pipeline import compress
from textmill.sources.contexts import from_conversations, from_text, read_one
from textmill.streaming.micro import compress_stream

SEG = "ctx_id bigint, seg_idx int, tokens bigint, importance_score double, importance0 double, is_preserved boolean, is_redundant boolean, is_boilerplate boolean, budget bigint"


def chosen(df):
    return sorted(r.seg_idx for r in df.collect())


def frame(spark, rows, budget):
    return spark.createDataFrame([(1, i, t, s, s, p, r, b, budget) for i, (t, s, p, r, b) in enumerate(rows)], SEG)


def test_first_fit_passes_over_what_does_not_fit(spark):
    df = frame(spark, [(60, 0.9, False, False, False), (50, 0.8, False, False, False), (40, 0.7, False, False, False)], 100)
    assert chosen(select.extractive(df, 0.3)) == [0, 2] == chosen(select.fit(df))


def test_preserved_segments_come_first_even_over_the_budget(spark):
    df = frame(spark, [(5, 0.9, False, False, False), (90, 0.0, True, False, False), (5, 0.3, False, False, False)], 50)
    assert chosen(select.extractive(df, 0.3)) == [1]
    assert chosen(select.fit(df)) == [0, 2]


def test_head_and_tail(spark):
    rows = [(10, 0.1, False, False, False)] * 3 + [(10, 0.9, False, True, False), (10, 0.8, False, False, False)] + [(10, 0.2, False, False, False)] * 3
    assert chosen(select.with_ends(frame(spark, rows, 45), 15, 5)) == [0, 1, 4, 7]
    assert chosen(select.with_ends(frame(spark, rows[:1], 45), 15, 5)) == [0]


def test_ties_go_to_the_earlier(spark):
    df = frame(spark, [(10, 1.0, False, False, False)] * 4, 25)
    assert chosen(select.extractive(df, 0.3)) == [0, 1]


def segments(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "ctx_id bigint, seg_idx int, text string")


def test_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(8)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(60)] + ["a b c d e", "a b c d e", "A b c d e f"]
    sets = {r.seg_idx: frozenset(r.sh) for r in dedup.shingle_sets(segments(spark, texts)).where("seg_idx = rep").collect()}
    for t in (0.3, 0.5, 0.85, 1.0):
        want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}
        got = {(r.i, r.j) for r in dedup.jaccard_pairs(dedup.shingle_sets(segments(spark, texts)), t).collect()}
        assert got == want
    sigs = {i: dedup.minima(__import__("numpy").array(sorted(s), dtype="int64").view("uint64")) for i, s in sets.items()}
    for t in (0.5, 0.85):
        want = {(i, j) for i in sigs for j in sigs if i < j and (sigs[i] == sigs[j]).mean() >= t}
        assert {(r.i, r.j) for r in dedup.minhash_pairs(dedup.shingle_sets(segments(spark, texts)), t).collect()} == want


def test_clusters_are_transitive_and_the_best_member_stands_for_them(spark):
    a = [f"x{i}" for i in range(12)]
    texts = [" ".join(a), " ".join([*a[2:], "y1", "y2"]), " ".join([*a[4:], "y1", "y2", "y3", "y4"]), "quite another text altogether"]
    got = dedup.clusters(segments(spark, texts), 0.6).withColumn("score", F.element_at(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.9), F.lit(0.5)), F.col("seg_idx") + 1))
    rows = dedup.representatives(got, "score").orderBy("seg_idx").collect()
    assert [r.component for r in rows] == [0, 0, 0, 3] and [r.rep_idx for r in rows] == [1, 1, 1, 3]


def test_warnings_after_gaps_only(spark):
    texts = ["It begins here.", "They follow at once.", "as mentioned above, yes", "1. first", "the above code is it", "é" * 40]
    df = segments(spark, texts)
    got = [(r.seg_idx, r.kind) for r in coherence.warnings(df).orderBy("seg_idx").collect()]
    assert got == []
    kept = [(r.seg_idx, r.kind) for r in coherence.warnings(df.where("seg_idx in (1, 3, 5)")).orderBy("seg_idx", "kind").collect()]
    assert kept == [(1, "orphaned pronoun"), (3, "incomplete list")]
    assert {r.kind for r in coherence.warnings(df.where("seg_idx = 2")).collect()} == {"dangling reference", "orphaned code reference"}
    assert df.where("seg_idx = 5").select(coherence.preview(F.col("text"))).first()[0] == "é" * 25


LONG = "\n\n".join(f"Paragraph number {i} talks about topic{i} and subject{i * 7} with words{i} of its own." for i in range(12))


@pytest.mark.parametrize("compat", ["fixed", "reference"])
@pytest.mark.parametrize("budget", [Budget(tokens=60), Budget(share=0.3)])
def test_output_is_an_ordered_part_within_budget(spark, compat, budget):
    done = compress(from_text(spark, LONG), Options(budget=budget, compat=compat))
    out = done.results.first().output
    parts, s = out.split("\n\n"), done.stats.first()
    assert parts == [p for p in LONG.split("\n\n") if p in parts] and 0 < s.compressed_tokens <= 60 and s.segments_kept == len(parts) and s.segments_total == 12


def test_duplicates_leave_one(spark):
    parts = LONG.split("\n\n")
    parts[11] = parts[5]
    text = "\n\n".join(parts)
    total = compress(from_text(spark, text), Options(budget=Budget(tokens=10**6))).stats.first().original_tokens
    for compat, left in (("fixed", 1), ("reference", 0)):
        done = compress(from_text(spark, text), Options(budget=Budget(tokens=total - 1), compat=compat))
        assert done.results.first().output.count(parts[5]) == left
    done = compress(from_text(spark, text), Options(budget=Budget(tokens=total - 1), redundancy=False))
    assert done.segments.where("is_redundant").count() == 0


def test_statuses(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "tiny"), (4, "fits well within"), (5, LONG)], "ctx_id bigint, text string")
    done = compress(df, Options(budget=Budget(tokens=50)))
    got = {r.ctx_id: (r.status, r.output) for r in done.results.collect()}
    assert got[1] == got[2] == ("empty_input", None) and got[3] == ("no_segments", "tiny") and got[4] == ("pass_through", "fits well within") and got[5][0] == "compressed"
    s = {r.ctx_id: r for r in done.stats.collect()}
    assert s[3].original_tokens == 2 and s[3].segments_total == 0 and s[4].compression_ratio == 1.0
    per_row = compress(df.withColumn("b", F.lit(0)), Options(budget=Budget(column="b")))
    assert {r.status for r in per_row.results.where("ctx_id >= 4").collect()} == {"budget_error"}
    with pytest.raises(ConfigError):
        compress(df, Options(budget=Budget(tokens=50), head=40, tail=20))


def test_seven_percent_of_hundred_is_eight(spark):
    text = " ".join(["w"] * 77)  # 101 tokens; 7 % in doubles
    assert compress(from_text(spark, text), Options(budget=Budget.parse("7%"))).segments.select("budget").first().budget == 8


def test_preserved_code_and_empty_table(spark):
    text = LONG + "\n\n```\nvalue = compute(1, 2, 3)\n```\n"
    done = compress(from_text(spark, text), Options(budget=Budget(tokens=30), preserve_code=True))
    assert "value = compute" in done.results.first().output
    empty = compress(from_text(spark, text).where("false"), Options(budget=Budget(tokens=30)))
    assert empty.results.count() == empty.stats.count() == empty.warnings.count() == 0


def test_reports(spark):
    done = compress(from_text(spark, LONG), Options(budget=Budget(tokens=60)))
    assert "Compression Statistics\n======" in stats.report(done.stats).first().report
    assert stats.json(done.stats).first().json.startswith('{"original_tokens":')


def counted(spark, *pairs):
    """Statistics with ``(original, compressed)`` tokens and nothing else."""
    df = spark.createDataFrame([(i, o, c, 0, 0, 0, 0, 0) for i, (o, c) in enumerate(pairs)], "ctx_id bigint, " + ", ".join(f"{c} bigint" for c in stats.COUNTS))
    return stats.derive(df)


def test_report_rounds_ties_of_the_ratio_to_the_even_digit(spark):
    got = stats.report(counted(spark, (80, 13), (80, 11), (1000, 3), (0, 0))).orderBy("ctx_id").collect()
    assert [r.report.split("Compression ratio:  ")[1].split("\n")[0] for r in got] == ["   16.2%", "   13.8%", "    0.3%", "  100.0%"]


def test_json_rounds_ties_of_the_ratio_to_the_even_digit(spark):
    got = stats.json(counted(spark, (32, 13), (160, 53), (32, 11), (0, 0))).orderBy("ctx_id").collect()
    assert [r.json.split('"compression_ratio":')[1].split(",")[0] for r in got] == ["0.4062", "0.3312", "0.3438", "1.0000"]


def test_conversations(spark):
    df = spark.createDataFrame([(1, 1, "b", "yes"), (1, 0, "a", "hi"), (2, 0, "a", None)], "conv_id bigint, turn bigint, role string, text string")
    assert {r.ctx_id: r.text for r in from_conversations(df).collect()} == {1: "a: hi\n\nb: yes", 2: "a: "}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, LONG), (2, "small text here")], "ctx_id bigint, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ctx_id bigint, text string").parquet(str(tmp_path / "in"))
    compress_stream(source, Options(budget=Budget(tokens=60)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.ctx_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "compressed", 2: "pass_through"}


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "t.txt"
    f.write_text(LONG)
    assert main([str(f), "--budget", "60", "--stats", "--tokenizer", "approximate"], spark) == 0
    out = capsys.readouterr()
    assert out.out and "Compression Statistics" in out.err
    assert main([str(f), "--budget", "100000"], spark) == 0 and capsys.readouterr().out == LONG
    for argv, code in (
        (["nope.txt", "--budget", "5"], 1), ([str(f)], 2), ([str(f), "--budget", "5", "--aggressive", "--conservative"], 2), ([str(f), "--model", "none"], 3), ([str(f), "--budget", "0"], 4), ([str(f), "--budget", "150%"], 4),
        ([str(f), "--budget", "50", "--preserve-head", "60"], 4),
    ):
        assert main(argv, spark) == code
    (tmp_path / "e.txt").write_text(" \n")
    with pytest.raises(ValueError):
        read_one(str(tmp_path / "e.txt"))


def test_null_and_repeated_ids_and_ids_of_any_type(spark):
    other = LONG.replace("topic", "matter")
    rows = [(None, LONG), ("a", LONG), ("a", other), (None, other), ("b", "fits well within")]
    df = spark.createDataFrame(rows, "ctx_id string, text string")
    done = compress(df, Options(budget=Budget(tokens=60)))
    got = sorted((str(r.ctx_id), r.output) for r in done.results.collect())
    alone = {t: compress(from_text(spark, t), Options(budget=Budget(tokens=60))).results.first().output for t in (LONG, other)}
    assert got == sorted([("None", alone[LONG]), ("a", alone[LONG]), ("a", alone[other]), ("None", alone[other]), ("b", "fits well within")])
    s = [(str(r.ctx_id), r.segments_total) for r in done.stats.collect()]
    assert sorted(s) == sorted([("None", 12), ("a", 12), ("a", 12), ("None", 12), ("b", 1)])
    done.release()
    assert done.paths == []


def test_a_context_of_a_hundred_thousand_segments(spark):
    text = "\n".join(f"line {i} of word{i * 7919 % 5003} and word{i * 31 % 4001}" for i in range(100_000))
    done = compress(from_text(spark, text), Options(budget=Budget(tokens=50_000), mode="line", redundancy=False))
    s = done.stats.first()
    assert s.segments_total == 100_000 and 45_000 < s.compressed_tokens <= 50_000
    done.release()


def test_verification_and_redundancy(spark):
    parts = LONG.split("\n\n")
    parts[11] = parts[5]
    done = compress(from_text(spark, "\n\n".join(parts)), Options(budget=Budget(tokens=80)))
    v, r = select.verify(done.segments).first(), dedup.redundancy(done.segments).first()
    assert v.within and v.used == done.stats.first().compressed_tokens and v.budget == 80
    assert r.redundant == 1 and r.unique == [i for i in range(12) if i not in {5, 11} - {*r.unique}] and len(r.unique) == 11
    over = done.segments.withColumn("selected", F.lit(True))
    assert not select.verify(over).first().within


def test_reference_mode_counts_byte_pairs_and_compares_sketches(spark):
    public = pytest.importorskip("public_tokenizers")
    o = Options(budget=Budget(tokens=200), compat="reference", vocabulary=public.path("byte_bpe_50k.tiktoken"))
    assert o.counter == "openai" and o.likeness == "minhash" and Options().counter == "approximate" and Options().likeness == "jaccard"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sum(len(tok.encode(p, add_special_tokens=False).ids) for p in LONG.split("\n\n"))
    assert compress(from_text(spark, LONG), o).stats.first().original_tokens == want


def test_budget_by_model_column(spark):
    df = spark.createDataFrame([(1, LONG, "gpt-4"), (2, LONG, "GPT-4o"), (3, LONG, "none"), (4, LONG, None)], "ctx_id bigint, text string, m string")
    got = {r.ctx_id: r.status for r in compress(df, Options(budget=Budget(model_column="m", reserve=8100))).results.collect()}
    assert got == {1: "compressed", 2: "pass_through", 3: "budget_error", 4: "budget_error"}


def test_usual_configuration_path_and_progress(monkeypatch, tmp_path):
    from textmill import progress
    from textmill.cli import options_from, parser
    from textmill.config import default_config_path

    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert default_config_path() == tmp_path / "textmill" / "config.toml"
    (tmp_path / "textmill").mkdir()
    (tmp_path / "textmill" / "config.toml").write_text("[thresholds]\nimportance_minimum = 0.5\n")
    assert options_from(parser().parse_args(["--budget", "10"])).thresholds.importance_min == 0.5
    monkeypatch.delenv("XDG_CONFIG_HOME")
    monkeypatch.delenv("HOME", raising=False)
    assert default_config_path() is None

    class Terminal(list):
        isatty, write = (lambda self: True), list.append

    out = Terminal()
    show = progress.on_terminal(50_000, out)
    for stage in progress.STAGES:
        show(stage)
    assert len(out) == 5 and "90% (reassembling)" in out[-1] and progress.on_terminal(49_999, out) is progress.quiet
