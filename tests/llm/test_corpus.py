"""Registration, twins and the pipeline."""

import re

import corpus_pipeline
import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__
from riskloom import llm


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(llm.QUERIES[name](spark, SF), llm.ORACLES[name], connect(SF)) == ""


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert [sum(bool(re.match(rf"op{n}_", q)) for q in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_stage_by_stage(spark):
    """Every stage against a plain version on the rows that it was given."""
    import hashlib

    import tiktoken
    from test_decontamination import plain as words_of
    from test_line_chunks import plain_dedup
    from test_simhash_groups import groups, plain

    from riskloom.llm import bpe, langid

    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    rows, took = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        took.append(rows)
        rows = corpus_pipeline.landed(stage(spark, rows, SF), "test-stage")
    assert all(t.columns == columns for t in took)
    given = [{r.doc_id: r for r in t.collect()} for t in took]

    known = langid.identify(took[0], langid.fit(took[0])).collect()
    assert set(given[1]) == {r.doc_id for r in known if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    assert len(given[1]) >= 0.99 * len(given[0])
    want = plain_dedup({i: r.text for i, r in given[1].items()})
    assert {i: r.text for i, r in given[2].items()} == want
    assert all(r.n_chars == len(r.text) for i, r in given[2].items() if r.text != given[1][i].text)
    least = {c for _, _, c in groups([(i, plain(r.text)) for i, r in given[2].items()])}
    assert set(given[3]) == least

    grams = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(item.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}

    def clean(text):
        w = words_of(text)
        return not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    assert set(given[4]) == {i for i, r in given[3].items() if clean(r.text)}
    engine = bpe.engine(*bpe._defaults(None, None))
    own = tiktoken.Encoding("own", pat_str=bpe._defaults(None, None)[1], mergeable_ranks=engine.ranks, special_tokens={})
    got = {r.doc_id: (list(r.ids), r.n_tokens, r.decoded_sha256) for r in rows.collect()}
    for i, r in given[4].items():
        ids = own.encode_ordinary(r.text or "")
        assert got[i] == (ids, len(ids), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert set(got) == set(given[4])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
