import pytest
from pyspark.sql import functions as F

from riskloom.session import fresh_path
from riskloom.sources import files
from riskloom.streaming import jobs


def test_rerun_adds_nothing_and_late_rows_are_left_out(spark):
    path = fresh_path(spark, "late")
    schema = "ts timestamp, value double"

    def land(rows):
        df = spark.createDataFrame([(t, v) for t, v in rows], "ts string, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        windows = jobs.quality_windows(stream, "ts", "value", 0, 10)
        jobs.write_windows(windows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
        out = spark.read.parquet(f"{path}/out").orderBy("window_start").collect()
        return [(r["window_start"].hour, r["row_count"], r["out_of_range"]) for r in out]

    land([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", 99.0), ("2024-01-01 02:30:00", None)])
    assert run() == [(0, 2, 1)]
    assert run() == [(0, 2, 1)]
    land([("2024-01-01 00:30:00", 5.0), ("2024-01-01 04:30:00", 5.0)])  # the first one is too late
    assert run() == [(0, 2, 1), (2, 1, 0)]


def test_both_sinks_show_a_batch_together_or_not_at_all(spark, monkeypatch):
    """A job that stops between its two writes, and its second run."""
    path = fresh_path(spark, "commit")
    texts = spark.createDataFrame([(k, str(k % 3)) for k in range(60)], "row_id long, flag string")
    texts.write.parquet(f"{path}/in")

    def parts(held, contract, keys):
        good, bad = held.where("flag <> '0'"), held.where("flag = '0'")
        return good, (bad.withColumn("flag", F.raise_error(F.lit("disk lost"))) if failing else bad)

    monkeypatch.setattr(jobs, "split_valid", parts)

    def run():
        rows = spark.readStream.schema(texts.schema).parquet(f"{path}/in")
        jobs.score_stream(rows, [], lambda good: good, f"{path}/out", f"{path}/checkpoint").awaitTermination()

    failing = True
    with pytest.raises(Exception, match="disk lost"):
        run()
    assert spark.read.parquet(f"{path}/out/good").count() == 40  # written, and not committed
    with pytest.raises(ValueError, match="committed"):
        jobs.read_committed(spark, f"{path}/out", "good")
    failing = False
    run()
    run()
    good, bad = (jobs.read_committed(spark, f"{path}/out", sink) for sink in ("good", "quarantine"))
    assert (good.count(), good.select("row_id").distinct().count(), bad.count()) == (40, 40, 20)
    assert good.columns == ["row_id", "flag", "batch_id"]
    assert spark.read.parquet(f"{path}/out/good").count() == 80


def test_gate_waits_for_labels_and_skips_without(spark):
    path = fresh_path(spark, "labels")
    p_schema, l_schema = "id long, made timestamp, p double", "id long, known timestamp, y double"

    def land(name, schema, rows):
        text = schema.replace("timestamp", "string")
        time = "made" if "made" in schema else "known"
        df = spark.createDataFrame(rows, text).withColumn(time, F.col(time).cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")

    def run():
        made = spark.readStream.schema(p_schema).parquet(f"{path}/p")
        known = spark.readStream.schema(l_schema).parquet(f"{path}/l")
        windows = jobs.gate_windows(jobs.await_labels(made, known, "id", "made", "known"), "made", "p", "y", 0, 10)
        jobs.write_windows(windows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
        out = spark.read.schema(windows.schema).parquet(f"{path}/out").orderBy("window_start").collect()
        return [(r.window_start.hour, r.row_count, r.labelled, r.violations, r.status) for r in out]

    at = "2024-01-01 {}:00".format
    land("p", p_schema, [(1, at("00:10"), 1.0), (2, at("00:20"), 11.0), (3, at("00:30"), None), (4, at("01:10"), 4.0)])
    land("l", l_schema, [(1, at("00:50"), 1.0), (2, at("03:00"), 7.0), (4, at("01:20"), 9.0)])
    assert run() == []  # labels may still come
    land("p", p_schema, [(5, at("09:00"), 1.0)])
    land("l", l_schema, [(6, at("09:00"), 1.0)])
    # The label of 2 came too late, 3 has no score; one exact pair passes, one miss fails.
    assert run() == [(0, 3, 1, 2, "pass"), (1, 1, 1, 0, "fail")]

    def table(schema, rows):
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        return df.withColumn(df.columns[1], F.col(df.columns[1]).cast("timestamp"))

    made = table(p_schema, [(1, at("00:10"), 1.0), (None, at("00:11"), 2.0), (3, None, 2.0)])
    known = table(l_schema, [(None, at("00:12"), 2.0), (1, at("00:05"), 1.0)])
    rest = jobs.gate_windows(jobs.await_labels(made, known, "id", "made", "known"), "made", "p", "y", 0, 10)
    assert [(r.row_count, r.labelled, r.status, r.r2) for r in rest.collect()] == [(2, 0, "skip", None)]
    assert jobs.gate_windows(jobs.await_labels(made.limit(0), known, "id", "made", "known"), "made", "p", "y", 0, 1).count() == 0


def test_headers_in_another_order_stop_the_stream(spark):
    path = fresh_path(spark, "header")
    spark.createDataFrame([(1, 2)], "b int, a int").write.option("header", True).csv(f"{path}/in")
    rows = jobs.read_csv_stream(spark, f"{path}/in", ["a", "b"])
    stream = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c")
    with pytest.raises(Exception, match="(?i)header"):
        stream.trigger(availableNow=True).start().awaitTermination()


def test_texts_survive_a_csv_round_trip(spark):
    path = fresh_path(spark, "csv")
    texts = [" lead ", "a\nb", 'say "hi", \\"so\\"', "\ttab\t", "a\r\nb", "plain", "it's, ok"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "k string, t string")
    files.write_csv(df, path)
    got = {r.k: r.t for r in files.read_csv(spark, path, ["k", "t"], multiline=True).collect()}
    assert got == {str(k): t for k, t in enumerate(texts)}


def test_no_python_in_the_plans(spark):
    from conftest import SF

    from riskloom.plans import QUERIES

    for name in ("e19_portfolio_total", "c9_valid_rows", "d8_polynomial_loans", "m5_metrics", "m7_qq_points"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan
