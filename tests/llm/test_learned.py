"""Language ID and toxicity: held-out accuracy and odd rows."""

import zlib

import pytest

from riskloom.llm import langid, toxicity

SF10 = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (None, "é"), (5, "the and of that is " * 3000), (5, "x"), (5, "x")]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_languages(spark):
    docs = spark.read.parquet(f"{SF10}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.op2(spark, SF10).collect()
    assert len(rows) == len(truth) and all(r.held_out == is_held(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)

    model = langid.fit(docs, sample=50)
    odd = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, score double")
    found = langid.identify(odd, model).collect()
    assert [r.lang_pred for r in found if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert len(found) == len(ODD) and all(r.lang_pred in {"de", "en", "es", "fr"} for r in found if r.doc_id in (4, 5, None))
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.identify(odd.limit(0), model).count() == 0


def test_languages_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    one = spark.createDataFrame([(k, "some text", "xx") for k in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one, langid.fit(one)).collect()} == {"xx"}


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels)


def test_toxicity(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxic_model).collect()}
    held = [(scores[i], y) for i, y in truth.items() if is_held(i) and i in scores]
    bad = [s for s, y in held if y == 1]
    clean = [s for s, y in held if y == 0]
    assert sum(a > b for a in bad for b in clean) >= 0.95 * len(bad) * len(clean)
    assert sum(s >= toxicity.TOXIC for s in clean) <= 0.02 * len(clean)

    odd = spark.createDataFrame([(*r, 0.5) for r in ODD], "doc_id long, text string, score double")
    found = toxicity.score(odd, toxic_model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score < toxicity.TOXIC for r in found)
    assert toxicity.score(odd.limit(0), toxic_model).count() == 0


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    clean = spark.createDataFrame([(k, 0) for k in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert all(r.score < 0.3 for r in toxicity.score(docs, toxicity.fit(docs, clean)).collect())


def test_toxicity_has_one_prior_at_every_sample(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    small = toxicity.fit(docs, labels, sample=200)  # below both classes; the other is above both
    means = []
    for model in (toxic_model, small):
        scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        clean = [scores[i] for i, y in truth.items() if y == 0 and is_held(i) and i in scores]
        means.append((sum(clean) / len(clean), sum(s >= toxicity.TOXIC for s in clean) / len(clean)))
    assert means[1][0] <= means[0][0] + 0.02 and means[1][1] <= 0.01, means
