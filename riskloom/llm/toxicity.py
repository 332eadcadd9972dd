"""Toxicity: a linear classifier over character n-grams scaled by their naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, landed, least_keys, query, table
from .ngrams import codes, hashes, slices

BITS = 18
SIZES = (3, 4, 5)
# N-grams that tell the classes apart best, and labelled documents per class that weigh them.
FEATURES = 1024
SAMPLE = 3000
SMOOTH = 1.0
TOXIC = 0.7


def grams(text: str | None, table_of: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams inside words (their edges count as a character), through ``table_of`` if given."""
    points = codes(text)
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    found = []
    for part in slices(points, max(SIZES) - 1):
        letter = part != 0
        for n in SIZES:
            size = len(part) - n + 1
            if size <= 0:
                continue
            inside = letter[1 : 1 + size].copy()
            for k in range(2, n - 1):
                inside &= letter[k : k + size]
            h = hashes(part, n, BITS)[inside]
            if table_of is not None:
                h = table_of[h]
                h = h[h >= 0]
            found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """Place of each bucket among the chosen ones (-1: none), their weights (ratio times coefficient), the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.bias + self.weights[grams(t, self.places)].sum() for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, key, text, toxic`` of documents with a label that no test holds out.

    Several labels of one id: toxic if any says so. Rows that repeat id and text are all kept here.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # A table of its own, so that the join can split the rows of an id that is everywhere.
    marks = landed(marks, "toxic-labels")
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "text")
    # Labels grow with the documents: the join is by shuffle at every size.
    return rows.join(marks.hint("merge"), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", "toxic")


def _document_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each bucket the documents of either class that hold it, over all labelled rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for part in batches:
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                count[toxic, grams(text)] += 1
                n[toxic] += 1
        some = np.flatnonzero(count.sum(axis=0))
        # The numbers of documents go under a bucket that no n-gram has.
        yield pd.DataFrame(
            {"bucket": np.append(some, -1), "clean": np.append(count[0, some], n[0]), "bad": np.append(count[1, some], n[1])}
        )

    sums = (
        rows.select("text", "toxic")
        .mapInPandas(run, "bucket int, clean long, bad long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
        .toPandas()  # at most 2^BITS + 1 rows
    )
    count = np.zeros((2, (1 << BITS) + 1))
    count[0, sums["bucket"]], count[1, sums["bucket"]] = sums["clean"], sums["bad"]
    return count[0, :-1], count[1, :-1], int(count[0, -1]), int(count[1, -1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts over all labelled rows; weights from at most ``sample`` of each class, those of least hash.

    A sampled row weighs as many rows as it stands for, so the score goes with the share of toxic rows as
    given at every size of the table.
    With one class only (or no labels) every score is the smoothed share of toxic rows.
    """
    # Read three times below, moved once.
    rows = landed(labelled(docs, labels), "labelled")
    clean, bad, n_clean, n_bad = _document_counts(rows)
    places, share = np.full(1 << BITS, -1, np.int32), (n_bad + 1) / (n_bad + n_clean + 2)
    if not n_clean or not n_bad:
        return Model(places, np.zeros(1), float(np.log(share / (1 - share))))
    in_bad, in_clean = (bad + SMOOTH) / (n_bad + 2 * SMOOTH), (clean + SMOOTH) / (n_clean + 2 * SMOOTH)
    ratio = np.log(in_bad / in_clean)
    sure = np.abs(ratio) / np.sqrt(1 / (bad + SMOOTH) + 1 / (clean + SMOOTH))
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    places[chosen] = np.arange(len(chosen))
    scale = ratio[chosen]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = np.zeros((len(part), len(scale)))
            for k, text in enumerate(part["text"]):
                at = grams(text, places)
                made[k, at] = scale[at]
            yield pd.DataFrame({"label": part["toxic"].to_numpy(np.float64), "x": list(made)})

    picked = least_keys(rows.select("toxic", "key"), "toxic", {0: n_clean, 1: n_bad}, sample)
    # At most twice ``sample`` keys.
    some = rows.join(F.broadcast(picked), ["toxic", "key"]).dropDuplicates(["toxic", "key"])
    ready = landed(some.select("text", "toxic").mapInPandas(run, "label double, x array<double>"), "toxic-sample")
    taken = {int(r.label): r["count"] for r in ready.groupBy("label").count().collect()}  # two rows
    weight = F.when(F.col("label") == 1, n_bad / taken[1]).otherwise(n_clean / taken[0])
    ready = ready.select("label", weight.alias("weight"), array_to_vector("x").alias("vector"))
    fitted = LogisticRegression(featuresCol="vector", weightCol="weight", maxIter=100, regParam=1e-3, standardization=False).fit(ready)
    return Model(places, scale * fitted.coefficients.toArray(), float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``, one row per row of ``docs``. Null and empty texts get the score of no n-gram."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(texts)), dtype="float64")

    return docs.select(F.col("doc_id").cast("long"), rate(F.col("text")).alias("score"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )
