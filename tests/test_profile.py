import numpy as np
import pandas as pd
import pytest

from riskloom.operators import profile
from riskloom.operators.columns import classify_columns, enforce_contract, guard_input
from riskloom.operators.quality import impute, modes
from riskloom.operators.quantiles import exact_quantiles, with_global_rank


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows hold one value."""
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 10, 2500), np.full(1500, 1.5), rng.integers(0, 5, 500)])
    rng.shuffle(values)
    pdf = pd.DataFrame({"row_id": range(len(values)), "v": values.astype(float)})
    pdf["w"] = pdf["row_id"].where(pdf["row_id"] % 2 == 0).astype(float)
    return spark.createDataFrame([(int(a), float(b), None if np.isnan(c) else float(c)) for a, b, c in pdf.values],
                                 "row_id long, v double, w double").repartition(4), pdf


PROBABILITIES = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]


@pytest.mark.parametrize("small,accuracy", [(10**6, 2000), (40, 20), (5, 100)])
def test_quantiles_are_exact_whatever_the_bracket(skewed, small, accuracy):
    df, pdf = skewed
    got = exact_quantiles(df, ["v", "w"], PROBABILITIES, small=small, accuracy=accuracy)
    for c in ("v", "w"):
        assert got[c] == pytest.approx(np.quantile(pdf[c].dropna(), PROBABILITIES), abs=1e-12)


@pytest.mark.parametrize("small", [5, 10**6])
def test_quantiles_with_infinities_and_nulls(spark, small):
    values = [float(v) for v in range(60)] + [float("inf")] * 20 + [float("-inf")] * 9 + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "v double")
    held = sorted(v for v in values if v is not None)
    for p in (0.0, 0.05, 0.3, 0.5, 0.9, 1.0):
        place = p * (len(held) - 1)
        low, high, part = held[int(place)], held[min(int(place) + 1, len(held) - 1)], place - int(place)
        want = low if not part or low == high else (1 - part) * low + part * high
        assert exact_quantiles(df, ["v"], [p], small=small)["v"][0] == pytest.approx(want)


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "k long, v double")
    box = profile.box_stats(df, "v").first()
    assert (box["q1"], box["lower_fence"], box["upper_whisker"], box["outliers"]) == (None, None, None, 0)
    assert profile.box_outliers(df, "v").count() == 0
    assert sum(r["n"] for r in profile.histogram(df, "v").collect()) == 0


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 50.0, 100.0, 100.5, None, 1e9)], "v double")
    bins = {r["bin"]: r["n"] for r in profile.histogram(df, "v", bins=10).collect()}
    assert (bins[0], bins[1], bins[6], bins[10], bins[11]) == (1, 1, 1, 1, 2) and sum(bins.values()) == 6


def test_spearman_takes_pairs_as_they_are(spark):
    pdf = pd.DataFrame({"row_id": range(60), "a": [k * 7 % 31 for k in range(60)], "b": [k * k % 17 for k in range(60)]})
    pdf["c"] = pdf["a"].where(pdf["row_id"] % 2 == 0, np.nan) + pdf["b"]
    rows = [(int(i), float(a), float(b), None if np.isnan(c) else float(c)) for i, a, b, c in pdf.values]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    want = pdf[["a", "b", "c"]].corr(method=lambda x, y: pd.Series(x).rank().corr(pd.Series(y).rank()))
    for r in profile.spearman_matrix(df, ["a", "b", "c"]).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["column_a"], r["column_b"]])


def test_long_keys_keep_their_order(spark):
    rows = [(2**53, 1.0, "it's"), (2**53 + 1, 2.0, "b"), (2**53 + 2, 3.0, "c")]
    df = spark.createDataFrame(rows[::-1], "k long, `it's` double, t string")
    got = profile.monotonic_profile(df, ["it's"], "k").first()
    assert (got["column_name"], got["rising"], got["falling"]) == ("it's", True, False)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


def test_global_rank_is_a_permutation_in_order(skewed):
    df, pdf = skewed
    rows = sorted(with_global_rank(df, "v", "row_id", buckets=16).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(pdf) + 1))
    assert [r["v"] for r in rows] == sorted(pdf["v"])


def test_average_ranks_and_spearman(skewed):
    df, pdf = skewed
    ranks = {r["value"]: r["rank"] for r in profile.column_ranks(df, ["v"]).collect()}
    assert [ranks[v] for v in pdf["v"]] == list(pdf["v"].rank())
    whole = pdf.dropna()
    got = profile.spearman_matrix(df, ["v", "w"]).first()["correlation"]
    assert got == pytest.approx(whole["v"].rank().corr(whole["w"].rank()))


def test_profile_against_pandas(skewed):
    df, pdf = skewed
    got = {r["column_name"]: r for r in profile.variable_profile(df, "row_id").collect()}
    v, p = got["v"], pdf["v"]
    assert (v["count"], v["distinct_values"]) == (len(p), p.nunique())
    for name, want in {"skewness": p.skew(), "kurtosis": p.kurt(), "std": p.std(), "mad": (p - p.median()).abs().median(),
                       "iqr": p.quantile(0.75) - p.quantile(0.25)}.items():
        assert v[name] == pytest.approx(want)
    assert not v["rising"] and not got["w"]["rising"] and got["w"]["missing"] == pdf["w"].isna().sum()


def test_monotonic(spark):
    df = spark.createDataFrame([(i, float(i // 3), float(-i), 1.0) for i in range(200)], "k long, up double, down double, flat double")
    got = {r["column_name"]: (r["rising"], r["falling"]) for r in profile.monotonic_profile(df, ["up", "down", "flat"], "k").collect()}
    assert got == {"up": (True, False), "down": (False, True), "flat": (True, True)}


def test_pearson_with_gaps_leaves_rows_out_pairwise(skewed):
    df, pdf = skewed
    assert profile.pearson_matrix(df, ["v", "w"]).first()["correlation"] == pytest.approx(pdf["v"].corr(pdf["w"]))


def test_frequent_values_limit_before_the_shuffle(skewed):
    df, _ = skewed
    plan = profile.frequent_values(df, ["v"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert profile.frequent_values(df, ["v"], 3).orderBy("place").first()["value"] == "1.5"


def test_duplicates_need_equal_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "x int, y string")
    assert {(r["x"], r["y"], r["copies"]) for r in profile.duplicate_rows(df).collect()} == {(1, "a", 3)} | {(2, None, 2)}
    assert profile.duplicate_summary(df).first()["duplicates"] == 3


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (99.9,), (100.1,), (None,)], "s double")
    bins = {r["bin"]: r["n"] for r in profile.histogram(df, "s", bins=10).collect()}
    assert bins == {**{i: 0 for i in range(12)}, 1: 1, 10: 2, 11: 1}
    with pytest.raises(ValueError):
        profile.histogram(df, "s", bins=5)


def test_impute_median_and_smallest_mode(spark):
    df = spark.createDataFrame([(1, 1, "b"), (2, 2, "a"), (3, None, None)], "row_id int, n int, t string")
    assert modes(df, ["t"]) == {"t": "a"}
    last = impute(df).orderBy("row_id").collect()[-1]
    assert (last["n"], last["t"]) == (1.5, "a")


def test_classes_and_guards(spark):
    df = spark.range(200).selectExpr("id", "id % 3 AS few", "string(id) AS many", "string(id % 2) AS flag", "'2024' AS birthDate")
    assert classify_columns(df) == {"id": "numerical", "few": "categorical", "many": "other", "flag": "categorical", "birthDate": "date"}
    with pytest.raises(ValueError):
        enforce_contract(df, ["id"])
    with pytest.raises(ValueError):
        guard_input(df.filter("id < 0"), ["id"])
    with pytest.raises(ValueError):
        guard_input(df, ["nothing"])


def test_no_task_ranks_all_rows_of_a_frequent_value(spark, monkeypatch):
    """Most rows hold one value: few distinct values are broadcast, of many the frequent ones are."""
    n = 4000
    pdf = pd.DataFrame({"row_id": range(n)})
    pdf["a"] = [0.0 if k % 10 else float(k) for k in range(n)]
    pdf["b"] = [float(k * 7919 % n) for k in range(n)]
    pdf["c"] = [-1.0 if k % 4 else float(k % 3) for k in range(n)]
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, *v in pdf.values], "row_id long, a double, b double, c double")
    want = pdf[["a", "b", "c"]].rank().corr()
    monkeypatch.setattr(profile, "FEW", 10)
    for r in profile.spearman_matrix(df, ["a", "b", "c"]).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["column_a"], r["column_b"]])
    ranks = profile.column_ranks(df, ["a"])
    monkeypatch.setitem(profile._ranked.__globals__, "BUCKETS", 8)
    spread = []
    real = profile.F.xxhash64
    monkeypatch.setattr(profile.F, "xxhash64", lambda *c: spread.append(c) or real(*c))
    got = profile._ranked(profile.doubles(df, ["a"], "row_id"), "a", ranks, 401, n)
    assert spread and got.agg({"a": "sum"}).first()[0] == pytest.approx(n * (n + 1) / 2)
