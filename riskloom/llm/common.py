"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import configure, fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# Text that one batch may bring to a Python worker.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session with batches for Python workers bounded in bytes; long texts count, not rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of an id and a digest (some 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 300_000


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table marked for broadcast if it is counted to have at most ``most`` rows; else as it is."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """128-bit name of a text. With the id it names a row; repeated rows share it and their result."""
    return F.md5(F.coalesce(text, F.lit("")))


def least_keys(rows: DataFrame, group: str, sizes: dict, most: int) -> DataFrame:
    """``group, key``: of each group at most ``most`` distinct keys, those of least hash.

    ``key`` is an even 64-bit hash and ``sizes`` has the rows of each group, so a share of the
    hash range that holds about twice as many is looked at alone: what reaches one task is a few times
    ``most``, whatever the table.
    """
    below = F.lit(None).cast("double")
    for value, n in sizes.items():
        share = min(1.0, 2.0 * most / max(n, 1))
        below = F.when(F.col(group) == F.lit(value), float((share * 2.0 - 1.0) * 2.0**63)).otherwise(below)
    keys = rows.where(F.col("key").cast("double") <= below).select(group, "key").distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy("key"))
    return keys.withColumn("rank", rank).where(F.col("rank") <= most).select(group, "key")


def held_out(doc_id: Column) -> Column:
    """The third of the ids that no model may learn from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
