"""Language ID in two steps: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, landed, least_keys, query, table
from .ngrams import codes, hashes, slices

# Labelled documents per language that the machines are fitted on.
SAMPLE = 1000
BITS = 11
UNKNOWN = "und"
# Documents the pipeline rejects: without letters, or with less certainty than this.
LEAST_SCORE = 0.25
# Language families, fixed values; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "sino-tibetan": "my zh",
    "malayic": "id ms",
}
_FAMILY = {code: family for family, all_codes in FAMILIES.items() for code in all_codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the counts of hashed 1-, 2- and 3-grams of letters at length 1; None without any letter."""
    points = codes(text)
    if not points.any():
        return None
    count = np.zeros(1 << BITS, np.float64)
    # Words lie between zeros; the first and last are padded too. Grams of separators only are left out.
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    for part in slices(points, 2):
        inner = part[1:-1] != 0
        count += np.bincount(hashes(part, 3, BITS)[inner], minlength=len(count))
        pairs = hashes(part[:-1], 2, BITS)
        count += np.bincount(pairs[(part[:-2] != 0) | inner], minlength=len(count))
        count += np.bincount(hashes(part[1:-1], 1, BITS)[inner], minlength=len(count))
    count = np.sqrt(count)
    return count / np.sqrt((count * count).sum())


@dataclass
class Model:
    """Families with their weights (one column each), and a machine for each pair of languages of one family."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    members: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.families:
            return langs, scores
        for k, text in enumerate(texts):
            if (x := features(text)) is None:
                continue
            z = x @ self.weights + self.bias
            p = np.exp(z - z.max())
            best = int(p.argmax())
            langs[k], inside = self._within(self.families[best], x)
            scores[k] = float(p[best] / p.sum() * inside)
        return langs, scores

    def _within(self, family: str, x: np.ndarray) -> tuple[str, float]:
        """The language that wins most pairs (the summed certainty decides ties), and its mean certainty."""
        some = self.members[family]
        won = {lang: [0, 0.0] for lang in some}
        for a, b in combinations(some, 2):
            w, c = self.machines[a, b]
            sure = 1 / (1 + np.exp(-2 * np.clip(x @ w + c, -30, 30)))
            won[a if sure >= 0.5 else b][0] += 1
            won[a][1] += sure
            won[b][1] += 1 - sure
        lang = max(some, key=lambda name: (won[name][0], won[name][1]))
        return lang, won[lang][1] / (len(some) - 1) if len(some) > 1 else 1.0


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``lang, features``: at most ``sample`` documents of each language, those of least hash, none held out.

    Rows that repeat id, text and language count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    # At most ``sample`` keys per language, so this side is small whatever the input.
    chosen = least_keys(rows.select("lang", key.alias("key")), "lang", sizes, sample)
    found = rows.select("lang", "text", key.alias("key")).join(F.broadcast(chosen), ["lang", "key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [features(t) for t in rows["text"]]
            some = [k for k, x in enumerate(made) if x is not None]
            yield pd.DataFrame({"lang": rows["lang"].iloc[some].to_numpy(), "x": [made[k] for k in some]})

    return found.dropDuplicates(["lang", "key"]).select("lang", "text").mapInPandas(run, "lang string, x array<double>")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of documents that are not held out. Without any, every text is unknown."""
    rows = landed(training_rows(docs, sample), "language-sample")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())  # one row per language
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    size = 1 << BITS
    at = F.create_map(*[F.lit(v) for lang in langs for v in (lang, families.index(family_of(lang)))]) if langs else None
    ready = rows.withColumn("vector", array_to_vector("x"))
    weights, bias = np.zeros((size, len(families))), np.zeros(len(families))
    if len(families) > 1:
        known = ready.select("vector", at[F.col("lang")].cast("double").alias("label"))
        first = LogisticRegression(featuresCol="vector", maxIter=60, regParam=1e-4, family="multinomial", standardization=False)
        fitted = first.fit(known)
        weights, bias = fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray()
    machines = {}
    for some in members.values():
        for a, b in combinations(some, 2):
            known = ready.where(F.col("lang").isin(a, b)).select("vector", (F.col("lang") == a).cast("double").alias("label"))
            fitted = LinearSVC(featuresCol="vector", maxIter=60, regParam=1e-4, standardization=False).fit(known)
            machines[a, b] = (fitted.coefficients.toArray(), float(fitted.intercept))
    return Model(families, weights, bias, members, machines)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score``; columns with these names are replaced.

    Only the text decides. Null texts and texts without letters are unknown with score 0.
    """
    rest = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    rows = docs.select(*[docs[f.name] for f in rest], guess(docs["text"]).alias("__guess"))
    return rows.select(*[f.name for f in rest], "__guess.lang_pred", "__guess.score")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Documents whose language is known well enough, with the columns they came with."""
    found = identify(docs.select(F.struct(*docs.columns).alias("__row"), "text"), model)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select("__row.*")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
