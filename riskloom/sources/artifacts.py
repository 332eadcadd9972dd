"""Saved pipelines with the record of what they expect and produce."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.columns import schema_table


def save_artifacts(model: PipelineModel, path: str, raw: DataFrame, produced: DataFrame) -> None:
    """Fitted pipeline, raw input schema and output schema, side by side."""
    model.write().overwrite().save(f"{path}/pipeline")
    for name, df in (("raw_schema", raw), ("feature_schema", produced)):
        schema_table(df).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def load_schema(spark: SparkSession, path: str, name: str) -> list[tuple[str, str]]:
    """(column, type) pairs in order; as many as the table has columns."""
    schema = "position bigint, column_name string, column_type string"
    rows = spark.read.schema(schema).json(f"{path}/{name}").orderBy("position").collect()
    if not rows:
        raise ValueError(f"no {name} under {path}")
    return [(r["column_name"], r["column_type"]) for r in rows]


def load_artifacts(spark: SparkSession, path: str):
    """(model, raw schema, feature schema); an absent part raises."""
    return (
        PipelineModel.load(f"{path}/pipeline"),
        load_schema(spark, path, "raw_schema"),
        load_schema(spark, path, "feature_schema"),
    )
