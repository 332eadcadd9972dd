"""Queries of the streaming jobs (S). Each stream runs to the end of its input and is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, modelling, split
from ..schema import RAW_COLUMNS, RAW_CONTRACT
from ..session import fresh_path
from ..sources.files import write_csv
from ..sources.tables import loans, loans_dirty, table
from ..streaming import jobs
from .catalog import on_dirty, query, tidy
from .predictions import MODELS
from .quality import VIOLATIONS_SQL


def _scored(good):
    return good.select("row_id", "LoanPurpose", F.expr(MODELS["three_factor"]).alias("score"))


@query(
    "s1_stream_scoring",
    on_dirty(
        """SELECT 'good' AS sink, LoanPurpose AS detail, count(*) AS row_count, 
        round(avg(80 - 6E-2 * CreditScore + 12 * DebtToIncomeRatio + 10 * BankruptcyHistory), 6) AS mean_score FROM loans
        WHERE row_id NOT IN (SELECT row_id FROM violations) GROUP BY LoanPurpose
        UNION ALL SELECT 'quarantine', field || ':' || code, count(*), 0E0 FROM violations GROUP BY 2""",
        VIOLATIONS_SQL,
    ),
)
def stream_scoring(spark, sf_dir):
    df, path = loans_dirty(spark, sf_dir), fresh_path(spark, "stream")
    write_csv(df, f"{path}/in")
    rows = jobs.read_csv_stream(spark, f"{path}/in", df.columns, files_per_batch=4)
    rows = rows.withColumn("row_id", F.col("row_id").cast("bigint"))
    jobs.score_stream(rows, RAW_CONTRACT, _scored, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    good = jobs.read_committed(spark, f"{path}/out", "good").groupBy(F.col("LoanPurpose").alias("detail")).agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("score").alias("mean_score")
    )
    bad = jobs.read_committed(spark, f"{path}/out", "quarantine").select(F.inline("violations"))
    held = bad.groupBy(F.concat_ws(":", "field", "code").alias("detail")).agg(F.count(F.lit(1)).alias("row_count"))
    return tidy(
        good.withColumn("sink", F.lit("good")).unionByName(
            held.withColumns({"sink": F.lit("quarantine"), "mean_score": F.lit(0.0)})
        )
    )


@query(
    "s1_fitted_scoring",
    on_dirty(
        """SELECT 'stream good' AS fact, count(*) AS row_count FROM dirty WHERE row_id NOT IN (SELECT row_id FROM violations)
        UNION ALL SELECT 'stream quarantine', count(DISTINCT row_id) FROM violations
        UNION ALL SELECT 'keys', count(*) FROM dirty
        UNION ALL SELECT 'same prediction in a batch', count(*) FROM dirty WHERE row_id NOT IN (SELECT row_id FROM violations)""",
        VIOLATIONS_SQL,
    ),
)
def fitted_scoring(spark, sf_dir):
    """The fitted pipeline in a stream: every row is scored or set aside, and a batch gives the same numbers."""
    df = split.with_split(loans(spark, sf_dir)).drop("MaritalStatus", "LoanApproved")
    pipeline = features.build_pipeline(df.drop("row_id", "split", "RiskScore"))
    model, _, names = modelling.train_final(pipeline, df, {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 4})
    categorical = ["ApplicationDate", "EmploymentStatus", "EducationLevel", "HomeOwnershipStatus", "LoanPurpose"]
    numeric = [c for c in RAW_COLUMNS if c not in categorical]

    def score(good):
        return modelling.score_batch(model, good.drop("MaritalStatus"), numeric, categorical, names)

    dirty, path = loans_dirty(spark, sf_dir), fresh_path(spark, "fitted")
    write_csv(dirty, f"{path}/in")
    rows = jobs.read_csv_stream(spark, f"{path}/in", dirty.columns, files_per_batch=4)
    rows = rows.withColumn("row_id", F.col("row_id").cast("bigint"))
    jobs.score_stream(rows, RAW_CONTRACT, score, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    streamed = jobs.read_committed(spark, f"{path}/out", "good")
    held = jobs.read_committed(spark, f"{path}/out", "quarantine")
    batch, _ = modelling.score_checked(model, dirty.drop("MaritalStatus"), RAW_CONTRACT, numeric, categorical, names)
    same = streamed.join(batch.withColumnRenamed("prediction", "again"), "row_id").filter("prediction <=> again")
    keys = streamed.select("row_id").union(held.select("row_id")).distinct()
    facts = {"stream good": streamed, "stream quarantine": held, "keys": keys, "same prediction in a batch": same}
    counts = [rows.agg(F.lit(fact).alias("fact"), F.count(F.lit(1)).alias("row_count")) for fact, rows in facts.items()]
    return tidy(reduce(DataFrame.unionByName, counts))


_WINDOWS = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS row_count,
    count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value < 0 OR value > 50) AS out_of_range,
    round(avg(value), 6) AS mean_value
    FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w, max(ts) OVER () AS latest FROM events)
    {} GROUP BY w, event_type"""


@query(
    "s2_stream_quality",
    _WINDOWS.format("WHERE w + INTERVAL 1 HOUR <= time_bucket(INTERVAL 1 MILLISECOND, latest) - INTERVAL 10 MINUTE"),
)
def stream_quality(spark, sf_dir):
    """Windows closed by the watermark at the end of the input."""
    path, schema = fresh_path(spark, "windows"), table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = jobs.quality_windows(events, "ts", "value", 0, 50, "event_type")
    jobs.write_windows(windows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{path}/out").drop("window_end")
    return tidy(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query("s2_stream_completed", _WINDOWS.format(""))
def stream_completed(spark, sf_dir):
    """The stream's windows and its closing pass: late rows and open windows are all there."""
    path, source = fresh_path(spark, "windows"), table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    windows = jobs.quality_windows(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", 0, 50, "event_type")
    jobs.write_windows(windows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    delivered = spark.read.schema(windows.schema).parquet(f"{path}/out")
    rest = jobs.quality_windows(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", 0, 50, "event_type")
    whole = jobs.completed(delivered, jobs.closing_pass(rest, delivered, "event_type"), "event_type").drop("window_end")
    return tidy(whole.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query("s2_batch_quality", _WINDOWS.format(""))
def batch_quality(spark, sf_dir):
    """The same measures over the table at rest, all windows."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.quality_windows(events, "ts", "value", 0, 50, "event_type").drop("window_end")
    return tidy(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


# A plain score of every event and a label that some get soon, some too late, and some never.
_SCORED = """SELECT event_id, ts AS made_at, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * 0.9 + 1E0 / 3 END AS predicted FROM {0}"""
_LABELS = """SELECT event_id, known_at, actual FROM (
    SELECT event_id, ts + {1} AS known_at, value + event_id % 5 - 2.0 AS actual FROM {0}) x WHERE event_id % 11 <> 0"""
_GATED = f"""WITH p AS ({_SCORED.format("events")}),
    l AS ({_LABELS.format("events", "to_minutes(CAST(event_id % 180 AS INTEGER))")}),
    j AS (SELECT time_bucket(INTERVAL 1 HOUR, made_at) AS w, predicted AS p, actual AS y FROM p
        LEFT JOIN l ON p.event_id = l.event_id AND known_at >= made_at AND known_at <= made_at + INTERVAL 2 HOUR),
    s AS (SELECT w, count(*) AS row_count, count(*) FILTER (p IS NOT NULL AND y IS NOT NULL) AS labelled,
        count(*) FILTER (p IS NULL OR p < 0 OR p > 50) AS violations, min(p) AS min_score, max(p) AS max_score,
        avg(p) AS mean_score, sqrt(avg((y - p) * (y - p))) AS rmse,
        1 - sum((y - p) * (y - p)) / nullif(count(*) FILTER (p IS NOT NULL AND y IS NOT NULL)
            * var_pop(CASE WHEN p IS NOT NULL THEN y END), 0) AS r2,
        sum((y - p) * (y - p)) AS misses
        FROM j GROUP BY w),
    f AS (SELECT * EXCLUDE (r2, misses), CASE WHEN labelled > 0
        THEN coalesce(r2, CASE WHEN misses = 0 THEN 1E0 ELSE 0E0 END) END AS r2 FROM s)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, row_count, labelled, violations,
        round(min_score, 6) AS min_score, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score,
        round(rmse, 6) AS rmse, round(r2, 6) AS r2,
        CASE WHEN labelled = 0 THEN 'skip' WHEN r2 >= 0.85 AND rmse <= 3 THEN 'pass' ELSE 'fail' END AS status FROM f"""


def _gate(events):
    """Gate windows over ``events``, a stream or a table."""
    scored = events.selectExpr("event_id", "ts AS made_at", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * 0.9D + 1D / 3 END AS predicted")
    labels = events.where("event_id % 11 <> 0").selectExpr(
        "event_id", "ts + make_dt_interval(0, 0, event_id % 180) AS known_at", "value + event_id % 5 - 2.0D AS actual"
    )
    return jobs.gate_windows(jobs.await_labels(scored, labels, "event_id", "made_at", "known_at"), "made_at", "predicted", "actual", 0, 50)


@query("s2_stream_gate", _GATED)
def stream_gate(spark, sf_dir):
    """Accuracy gate per window of a stream whose labels come late: its windows and the closing pass."""
    path, source = fresh_path(spark, "gate"), table(spark, sf_dir, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    windows = _gate(events.withColumn("ts", F.col("ts").cast("timestamp")))
    jobs.write_windows(windows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    delivered = spark.read.schema(windows.schema).parquet(f"{path}/out")
    rest = _gate(source.withColumn("ts", F.col("ts").cast("timestamp")))
    closing = jobs.closing_pass(rest, delivered, counts=("row_count", "labelled"))
    whole = jobs.completed(delivered, closing).drop("window_end", "message")
    return tidy(whole.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))
