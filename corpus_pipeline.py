"""The corpus pipeline: one operator after another over ``documents``, a Parquet table between each two.

Every stage works on all rows its predecessor kept. All but the last return the columns they were
given; the last returns ``doc_id, n_tokens, ids, decoded_sha256``. Nulls, empty tables, repeated rows
and further columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, langid, lines, simhash
from riskloom.llm.common import landed, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters go."""
    return langid.keep_known(docs, langid.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that stand elsewhere before; ``n_chars`` follows the text."""
    cut = lines.cut_lines(docs, "__lines", "__removed")
    if "n_chars" in docs.columns:
        shorter = F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the bytes they decode to."""
    return bpe.encode(docs).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

# Language ID, SimHash (XXH64) and byte-level BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = landed(docs, "stage")
    return docs
