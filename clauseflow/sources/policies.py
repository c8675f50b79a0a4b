"""Policy files: one text per service and kind, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import names, text as tx


def policy_files(pages: DataFrame) -> DataFrame:
    """(service_name, kind, final_url, text) to (service, kind, file_name, content)."""
    return pages.select(
        names.folder_name(F.col("service_name")).alias("service"),
        "kind",
        tx.lookup(F.col("kind"), V.POLICY_FILENAMES).alias("file_name"),
        F.format_string(V.POLICY_FILE_HEADER, "final_url", "text").alias("content"),
    )


def write_policies(pages: DataFrame, root: str) -> None:
    """Replaces the partitions of the given services and kinds, and no others.

    The rebalance gathers each partition's rows into few files and still splits a
    partition that is large.
    """
    (
        policy_files(pages).hint("rebalance", "service", "kind").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("service", "kind")
        .parquet(root)
    )


def read_policies(spark: SparkSession, root: str) -> DataFrame:
    """The stored policy files below ``root`` as source documents; the header is part of the text."""
    schema = "service string, kind string, file_name string, content string"
    rows = spark.read.schema(schema).parquet(root)
    path = F.concat_ws("/", F.lit(root.rstrip("/")), "service", "file_name")
    return rows.select(
        path.alias("source"), F.col("file_name").alias("source_label"), F.lit("terms").alias("doc_type"),
        F.col("service").alias("service_name"), tx.lookup(F.col("kind"), V.POLICY_SUBTYPES).alias("doc_subtype"),
        F.lit("file").alias("source_kind"), F.col("content").alias("text"), "kind",
    )
