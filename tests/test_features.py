import pytest
from conftest import SF
from pyspark.ml import PipelineModel

from riskloom.operators import features as ops
from riskloom.operators import modelling, monitor, split
from riskloom.schema import RAW_COLUMNS
from riskloom.session import fresh_path
from riskloom.sources.tables import loans


def test_pipeline_columns_and_round_trip(spark):
    df = loans(spark, SF).select(*RAW_COLUMNS)
    kept = ops.build_pipeline(df).fit(df)
    parity = ops.build_pipeline(df, keep_ordinal=False).fit(df)
    assert len(kept.transform(df).columns) == 60 and len(parity.transform(df).columns) == 59
    path = fresh_path(spark, "pipeline")
    kept.write().save(path)
    again = PipelineModel.load(path).transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.transform(df).collect()))


def test_payment_capacity_type_depends_on_gaps(spark):
    columns = ", ".join(f"{c} double" for c in ops.CRAFTED_INPUTS)
    whole = spark.createDataFrame([(1.0, 2.0, 100.9, 10.0, 5.0, 50.0, 0.0)], columns)
    gappy = whole.union(spark.createDataFrame([(1.0, 2.0, None, 10.0, 5.0, 50.0, 10.0)], columns))
    a = ops.CraftedFeatures.of(on_zero="zero").fit(whole).transform(whole)
    b = ops.CraftedFeatures.of(on_zero="zero").fit(gappy).transform(gappy)
    assert dict(a.dtypes)["payment_capacity"] == "int" and dict(b.dtypes)["payment_capacity"] == "double"
    assert a.first()["payment_capacity"] == 85 and a.first()["loan_to_income_ratio"] == 0.0
    with pytest.raises(ValueError):
        ops.CraftedFeatures.of().fit(whole.drop("LoanAmount"))


def test_encoder_unseen_and_order(spark):
    train = spark.createDataFrame([("b", "Master"), ("a", "Bachelor"), ("c", "?")], "k string, EducationLevel string")
    model = ops.CategoryEncoder.of(one_hot=["k"]).fit(train)
    made = model.transform(spark.createDataFrame([("z", "Doctorate"), ("b", "none")], "k string, EducationLevel string"))
    assert made.columns == ["EducationLevel", "k_b", "k_c"]
    assert [tuple(r) for r in made.collect()] == [(4, 0.0, 0.0), (-1, 1.0, 0.0)]
    assert model.most_frequent == {"k": "a"}


def test_types(spark):
    df = spark.createDataFrame(
        [(1, 40000, None, 0.5, 1e300, "x")] * 3 + [(127, 1, 5, 0.25, 1.0, "x")],
        "tiny long, mid long, gap long, small double, big double, text string",
    )
    model = ops.TypeOptimizer.of(fixed={}).fit(df)
    assert model.types == {"tiny": "tinyint", "mid": "int", "gap": "bigint", "small": "float", "big": "double", "text": "category"}
    later = spark.createDataFrame([(1000, 1, 1, 0.5, 1.0, "y")], df.schema)
    assert model.transform(later).first()["tiny"] is None


def test_polynomial_names_and_missing_targets(spark):
    df = spark.createDataFrame([(2, 3, "t")], "A long, B long, C string")
    made = ops.polynomial(df, ["A", "B", "absent"], bias=True)
    assert made.columns == ["C", "bias", "A", "B", "A^2", "A*B", "B^2"]
    assert tuple(made.first())[1:] == (1.0, 2.0, 3.0, 4.0, 6.0, 9.0)
    assert ops.polynomial(df, ["absent"]).columns == df.columns


def test_bad_date_gives_null_parts(spark):
    df = spark.createDataFrame([("2024-02-29",), ("not-a-date",), (None,)], "D string")
    assert [tuple(r) for r in ops.date_parts(df, "D").collect()] == [(2024, 2, 29), (None, None, None), (None, None, None)]


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    one = {r["row_id"] for r in split.train_test(df.coalesce(1))[1].collect()}
    many = {r["row_id"] for r in split.train_test(df.repartition(7))[1].collect()}
    assert one == many and 300 < len(one) < 500
    train, test = split.train_test(df)
    assert train.count() + test.count() == 2000 and train.join(test, "row_id").count() == 0
    sample = split.sample_rows(df, 123)
    assert sample.count() == 123 and sample.distinct().count() == 123
    assert split.sample_rows(df, 5000).count() == 2000


def test_status_order(spark):
    def overall(*statuses, order=monitor.STATUS_ORDER):
        df = spark.createDataFrame([(s,) for s in statuses], "status string")
        return monitor.overall_status(df, order).first()["overall_status"]

    assert overall("pass", "pass") == "pass" and overall("skip", "pass") == "skip"
    assert overall("error", "skip") == "error" and overall("warn", "error") == "warn"
    assert overall("fail", "warn", "error") == "fail"
    assert overall("warn", "error", order=monitor.QUICK_STATUS_ORDER) == "error"


def test_draws_are_repeatable_and_in_range():
    for stage, space in modelling.STAGES.items():
        for trial in range(20):
            drawn = modelling.draw(stage, trial)
            assert drawn == modelling.draw(stage, trial) and set(drawn) == set(space)
            assert all(low <= drawn[n] <= high for n, (_, low, high) in space.items())
            assert all(drawn[n] % 50 == 0 for n in drawn if n == "n_estimators")


def test_trained_model_beats_the_mean(spark):
    from riskloom.plans import QUERIES

    rows = QUERIES["m1_m4_baseline_comparison"](spark, SF).collect()
    assert len(rows) == 5
    best = {r["model"]: r["test_r2"] for r in rows}
    assert best["BoostedTrees"] > 0.3 and best["Ridge"] > 0.3


def test_saved_model_scores_every_row(spark):
    from riskloom.plans import QUERIES

    report = {(r["section"], r["key"]): r["value"] for r in QUERIES["m16_m18_final_model"](spark, SF).collect()}
    assert report["final", "r2"] > 0.3 and report["sanity", "sane"] == 1.0
    assert QUERIES["m17_batch_scoring"](spark, SF).filter("prediction IS NOT NULL").count() == loans(spark, SF).count()


def test_tuning_resumes(spark):
    from riskloom.plans import QUERIES

    board = {r["study"]: r["completed"] for r in QUERIES["m12_m13_staged_tuning"](spark, SF).collect()}
    assert board == {"tree_complexity": 2, "gamma": 2, "sampling": 2, "regularization": 0, "learning_rate": 2}


def test_final_model_scores_rows_once(spark):
    from riskloom.plans import QUERIES

    plan = QUERIES["m16_m18_final_model"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan
