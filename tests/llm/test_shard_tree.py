"""The weighted hash tree."""

import zlib
from collections import Counter

import pytest
from conftest import SF

from riskloom.llm import sharding as s


def shards(spark, tree, n=20000):
    from pyspark.sql import functions as F

    rows = spark.range(n).select("id", s.descend(F.xxhash64(F.col("id").cast("string")), tree).alias("s"))
    return {r.id: r.s for r in rows.collect()}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = s.grid(2, 3, 4)
    before = shards(spark, tree)
    after = shards(spark, s.grown(tree, 24))
    again = shards(spark, s.grown(s.grown(tree, 24), 25))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {24} and 600 < len(moved) < 1000
    assert {again[k] for k in after if after[k] != again[k]} == {25}
    count = Counter(before.values())
    assert set(count) == set(range(24)) and max(count.values()) < 1.25 * min(count.values())


def test_weights(spark):
    tree = s.grid(2, 1, 3)
    heavy = s.reweighted(tree, 4, 3.0)
    before, after = shards(spark, tree), shards(spark, heavy)
    count = Counter(after.values())
    assert 2.6 < count[4] / count[5] < 3.4
    # Inside the region that gained, only shard 4 gains; the other region only loses.
    stay = [k for k in before if before[k] < 3 and after[k] < 3]
    assert all(before[k] == after[k] for k in stay)
    assert all(after[k] >= 3 for k in before if before[k] >= 3)
    assert 4 not in set(shards(spark, s.reweighted(tree, 4, 0.0)).values())


def test_whole_table(spark):
    rows = s.op4(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24)
    for shard in range(24):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize("slot_rows", [1, 7, 1000])
def test_slots_of_repeated_rows_and_nulls(spark, slot_rows):
    rows = [(1, "a")] * 40 + [(1, f"t{k}") for k in range(20)] + [(None, None)] * 5 + [(2, "é"), (3, ""), (3, None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, law string")
    got = s.shard_rows(s.measured(docs), s.grid(1, 2, 2), slot_rows=slot_rows).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert {(r.size, r.text_crc32) for r in got if r.text is None} == {(8, 0)}
    assert all(r.grown_shard is None for r in got)
    assert s.shard_documents(docs.limit(0), s.grid(1, 2, 2)).count() == 0
