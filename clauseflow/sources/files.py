"""Corpus files: enumeration and text decoding."""

from __future__ import annotations

import codecs
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseflow import vocab as V
from clauseflow.functions import paths

_BOMS = (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
_UTF8_BOM = "\ufeff"

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def list_files(
    spark: SparkSession, root: str, suffixes: Sequence[str] = V.SOURCE_SUFFIXES
) -> DataFrame:
    """All corpus files below ``root`` with their content; empty if there is no such folder.

    ``select("path")`` prunes the content column, so a plain listing opens no file.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        return spark.createDataFrame([], _FILE_SCHEMA)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .load(root)
    )


def _decode_one(data: bytes | None, encodings: Sequence[str]) -> str | None:
    if data is None:
        return None
    for name in encodings:
        # Any even number of bytes tends to pass as UTF-16, so it needs its mark.
        if name == "utf-16" and not data.startswith(_BOMS):
            continue
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return None


def decode_text(content: Column, encodings: Sequence[str] = V.TEXT_ENCODINGS) -> Column:
    """Bytes to text by the first encoding that fits; null if none does.

    UTF-8 is decoded in the JVM.  Only the other rows are sent to Python.
    """

    @F.pandas_udf(StringType())
    def legacy(column: pd.Series) -> pd.Series:
        return column.map(lambda b: _decode_one(b, encodings), na_action="ignore")

    plain = F.is_valid_utf8(content.cast("string"))
    decoded = F.regexp_replace(content.cast("string"), "^" + _UTF8_BOM, "")
    return F.when(plain, decoded).otherwise(legacy(F.when(~plain, content)))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Text files below ``root`` as source documents, metadata read off their paths."""
    path = F.col("path")
    return with_path_metadata(
        list_files(spark, root, ("txt",)).select("path", decode_text(F.col("content")).alias("text"))
    ).withColumn("source", path)


def with_path_metadata(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return (
        files.withColumn("doc_type", paths.doc_type(path))
        .withColumn("service_name", paths.service_name(path, F.col("doc_type")))
        .withColumn("doc_subtype", paths.doc_subtype(path))
        .withColumn("source_label", paths.file_name(path))
        .withColumn("source_kind", F.lit("file"))
    )
