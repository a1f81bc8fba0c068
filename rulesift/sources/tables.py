"""Driver tables as scan input: ``documents`` texts as files, their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.functions import text as T


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """One document = one file: repo = source, path = doc/<doc_id>.py."""
    return docs.select(F.col("source").alias("repo"), F.lit("main").alias("branch"),
                       F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
                       F.col("text"))


def document_lines(docs: DataFrame) -> DataFrame:
    """S6 on prose: (doc_id, line_number, line) with Python ``splitlines`` boundaries."""
    parts = F.col("_parts")
    return (docs.withColumn("_parts", F.split(F.col("text"), T.fixed.LINE_BREAK_RX, -1))
            .select("doc_id", F.posexplode(
                F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
                .alias("pos", "line"))
            .select("doc_id", (F.col("pos") + 1).cast("int").alias("line_number"), "line"))
