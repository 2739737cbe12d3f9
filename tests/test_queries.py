"""Every query with SQL gives the rows of that SQL on the smallest tables; the rest run."""

import math
import os

import pytest

import __spark_entry__ as entry
from textmill import queries

SF = entry.SMOKE
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x if isinstance(x, str) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_markdown_keeps_every_line(spark, tmp_path):
    lines = [f"line {i}" for i in range(1500)]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "one line"), (3, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.ctx_id: r.text for r in queries._markdown(spark, str(tmp_path)).collect()}
    assert got[1] == "# line 0\n\n" + "\n\n".join(lines[1:]) + "\n```text\nline 1499\n```\n## End\nlast words here\n"
    assert got[2] == "# one line\n\n\n```text\none line\n```\n## End\nlast words here\n" and got[3].startswith("# \n\n")


@needs_data
def test_byte_pairs_against_another_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = {(r.ctx_id, r.seg_idx): r.text for r in queries._lines(spark, SF).collect()}
    got = {(r.ctx_id, r.seg_idx): r.tokens for r in queries.tokens_bpe(spark, SF).collect()}
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


@needs_data
def test_dressed_documents_reach_every_rule(spark):
    kinds = {r.kind for r in queries.QUERIES["warnings_dressed"](spark, SF).select("kind").distinct().collect()}
    assert len(kinds) == 4
    states = {r.status for r in queries.QUERIES["compressed_dressed"](spark, SF).select("status").distinct().collect()}
    assert {"compressed", "pass_through"} <= states
    scores = {r.boilerplate_score for r in queries.boilerplate_dressed(spark, SF).select("boilerplate_score").distinct().collect()}
    assert {0.0, 0.75, 0.85, 0.9, 0.95} <= scores
