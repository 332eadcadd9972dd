"""Structured Streaming jobs: scoring with quarantine, windowed quality measures, and a gate over late labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import quoted
from ..operators.contracts import split_valid
from ..operators.monitor import accuracy_gate
from ..schema import Field, text_schema
from ..sources.files import QUOTING


def read_csv_stream(spark: SparkSession, path: str, columns: list[str], files_per_batch: int | None = None) -> DataFrame:
    """Growing folder of CSV files as text rows. A file whose header has other names, or these in another order, stops the stream."""
    reader = spark.readStream.schema(text_schema(columns)).options(**QUOTING).option("header", True)
    reader = reader.option("enforceSchema", False)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path)


def score_stream(
    rows: DataFrame, contract: list[Field], score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    keys: tuple[str, ...] = ("row_id",),
):
    """Good rows are typed and scored, bad ones kept with their violations.

    Every try of a micro-batch writes folders of its own; a manifest names the try that counts and is
    written last. ``read_committed`` reads only such tries, so both sinks show a batch together or
    not at all, and a batch repeated after a failure leaves no row twice. Folders of tries that
    failed are never read; whoever owns ``out`` may delete them.
    The batch is cached for its two writes; a lost block is computed again.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], "attempt string").write.mode("ignore").parquet(f"{out}/commits/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = f"try-{uuid.uuid4().hex}"
        held = batch.persist()
        try:
            good, bad = split_valid(held, contract, keys)
            score(good).write.parquet(f"{out}/good/batch_id={batch_id}/attempt={attempt}")
            bad.write.parquet(f"{out}/quarantine/batch_id={batch_id}/attempt={attempt}")
        finally:
            held.unpersist()
        manifest = batch.sparkSession.range(1).select(F.lit(attempt).alias("attempt"))
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/batch_id={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_committed(spark: SparkSession, out: str, sink: str) -> DataFrame:
    """Rows of ``good`` or ``quarantine`` whose micro-batch is committed, with its ``batch_id``.

    Before the first commit there is no schema to read by: a ``ValueError``. The names ``batch_id`` and
    ``attempt`` are the folders'; rows must not have columns of these names.
    """
    commits = spark.read.schema("attempt string, batch_id long").parquet(f"{out}/commits")
    if commits.isEmpty():
        raise ValueError(f"no batch of {out} is committed yet")
    rows = spark.read.parquet(f"{out}/{sink}").withColumn("batch_id", F.col("batch_id").cast("long"))
    # The manifest's keys are folder names of the sink, so other tries are pruned before they are read.
    kept = rows.join(commits, ["batch_id", "attempt"], "left_semi")
    return kept.select(*[quoted(c) for c in rows.columns if c != "attempt"])


def await_labels(
    predictions: DataFrame, labels: DataFrame, key: str, made: str, known: str,
    wait: str = "2 hours", delay: str = "10 minutes",
) -> DataFrame:
    """Every prediction with its label, or with nulls if none comes within ``wait``.

    Streams and tables alike. The columns of the two inputs must differ except for ``key``. On a stream
    the watermarks bound the state: a prediction is held until its label can no longer come. A null
    key or a null time meets no label. Two labels in time give two rows.
    """
    late = labels.withColumnRenamed(key, "label key").withWatermark(known, delay)
    made_at, known_at = F.col(made), F.col(known)
    meets = (F.col(key) == F.col("label key")) & (known_at >= made_at) & (known_at <= made_at + F.expr(f"INTERVAL {wait}"))
    return predictions.withWatermark(made, delay).join(late, meets, "left_outer").drop("label key")


def gate_windows(
    scored: DataFrame, time: str, predicted: str, actual: str, low: float, high: float, width: str = "1 hour",
) -> DataFrame:
    """Violation and score statistics per tumbling window, with the accuracy gate over the labelled rows.

    A score violates if it is missing or out of ``low`` to ``high``. Without a pair of score and label the
    window skips; where the labels don't vary, R2 is 1 if every score is exact, else 0. Sums are taken about
    no pivot: labels whose mean is many times their spread lose digits of R2.
    """
    p, y = F.col(predicted), F.col(actual)
    paired = p.isNotNull() & y.isNotNull()
    label, miss = F.when(paired, y), F.when(paired, y - p)
    spread = F.col("squares") - F.col("total") * F.col("total") / F.col("labelled")
    r2 = F.when(spread > 0, 1 - F.col("misses") / spread).otherwise(F.when(F.col("misses") == 0, 1.0).otherwise(0.0))
    sums = scored.groupBy(F.window(time, width)).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(label).alias("labelled"),
        F.count_if(p.isNull() | (p < low) | (p > high)).alias("violations"),
        F.min(p).alias("min_score"),
        F.max(p).alias("max_score"),
        F.avg(p).alias("mean_score"),
        F.sum(label).alias("total"),
        F.sum(label * label).alias("squares"),
        F.sum(miss * miss).alias("misses"),
    )
    known = F.col("labelled") > 0
    measured = sums.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "row_count", "labelled", "violations", "min_score", "max_score", "mean_score",
        F.when(known, F.sqrt(F.col("misses") / F.col("labelled"))).alias("rmse"),
        F.when(known, r2).alias("r2"),
    )
    return accuracy_gate(measured)


def quality_windows(events: DataFrame, time: str, value: str, low: float, high: float, *by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows, missing and out-of-range values, and mean value per tumbling window.

    Works on streams and tables alike. On a stream the watermark bounds the state: a window
    is emitted once, when the watermark has passed its end, and later rows are left out.
    """
    v = F.col(value)
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, width), *by)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(v.isNull()).alias("missing"),
            F.count_if((v < low) | (v > high)).alias("out_of_range"),
            F.avg(v).alias("mean_value"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
                "row_count", "missing", "out_of_range", "mean_value")
    )


def closing_pass(at_rest: DataFrame, delivered: DataFrame, *by: str, counts: tuple[str, ...] = ("row_count",)) -> DataFrame:
    """What a stream's sink lacks once its input is complete: open windows, and windows with late rows.

    ``at_rest`` are the windows over the whole input, ``delivered`` those of the sink; a window whose
    ``counts`` differ had late rows. The result replaces the sink's rows of the same window;
    ``completed`` puts both together.
    """
    keys = ["window_start", *by]
    held = delivered.select(*[F.col(k).alias(f"held {k}") for k in [*keys, *counts]])
    same = [at_rest[k].eqNullSafe(F.col(f"`held {k}`")) for k in [*keys, *counts]]
    return at_rest.join(held, reduce(Column.__and__, same), "left_anti")


def completed(delivered: DataFrame, closing: DataFrame, *by: str) -> DataFrame:
    """Every window once: delivered ones that nothing replaced, and the closing pass."""
    keys = ["window_start", *by]
    newer = closing.select(*[F.col(k).alias(f"new {k}") for k in keys])
    same = reduce(Column.__and__, [delivered[k].eqNullSafe(F.col(f"`new {k}`")) for k in keys])
    return delivered.join(newer, same, "left_anti").unionByName(closing)


def write_windows(windows: DataFrame, out: str, checkpoint: str):
    """Append sink: the file log makes every closed window appear once."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
