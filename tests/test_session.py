"""Settings the jobs rely on."""

from pyspark.sql import functions as F

from riskloom.session import configure, fresh_path


def test_tasks_read_bounded_parts_of_a_table(spark):
    """A file larger than a split is shared out, however few cores there are."""
    path = fresh_path(spark, "large")
    spark.range(5_000_000, numPartitions=1).select(F.rand(1).alias("x")).write.option("maxRecordsPerFile", 0).parquet(path)
    configure(spark).conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 2
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
