"""Session settings the jobs rely on, and the one shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; cluster sizing stays with whoever starts the session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows a task reads: compressed columns open out tenfold, and tree fits hold what a task read as objects.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Rows of one kept batch: a vector column takes some 270 bytes a row, and an array of megabytes fragments the heap.
    "spark.sql.inMemoryColumnarStorage.batchSize": "500",
    # Past 8000 bytes the JVM no longer compiles a method; wide checks run faster unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", app: str = "riskloom", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. Cluster jobs bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        # Small tables would land as one file and keep one core busy.
        .config("spark.sql.files.maxRecordsPerFile", "20000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir(spark.sparkContext.applicationId)


@lru_cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="riskloom-")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back, for inputs that are passed over several times.

    The written table cuts the lineage and survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``df`` kept on the disks of the executors, until it is let go by ``unpersist``.

    Never in their memory: rows of vectors filled the share that storage may take and left the fits too little.
    A lost block is computed again.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def discard(spark: SparkSession, files: list[str]) -> None:
    """Delete the table of these files, which ``settle`` wrote, once nothing reads it any more."""
    for file in files[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(file)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(spark: SparkSession) -> None:
    """Fits of many rounds write their state every few rounds, to the shared folder unless another is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(fresh_path(spark, "rounds"))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept by the executors while it is passed over.

    For rows that a fit reads several times: a vector is read from there in half the time that its
    Parquet columns take.
    """
    held = keep(df)
    try:
        yield held
    finally:
        held.unpersist()
