"""Crawled documents, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import paths, text as tx

LINE_SCHEMA = (
    "service_name string, document_type string, title string, source_url string, "
    "source_kind string, revision_date string, text string, _corrupt string"
)


def read_lines(spark: SparkSession, root: str, stream: bool = False, glob: str = "*.jsonl", **options: str) -> DataFrame:
    """Lines with their path and a position that orders them within each file."""
    reader = spark.readStream if stream else spark.read
    lines = (
        reader.format("text").schema("value string")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).options(**options)
        .load(root)
        .select("value", F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"))
    )
    return lines if stream else with_positions(lines)


def with_positions(lines: DataFrame) -> DataFrame:
    """Rows of one file split arrive in order; splits are ordered by file and offset."""
    return lines.withColumn(
        "position", F.struct("path", "_block", F.monotonically_increasing_id().alias("row"))
    ).drop("_block")


def parse_lines(lines: DataFrame, min_chars: int = V.MIN_BODY_CHARS) -> DataFrame:
    """(path, value, position) to source documents.

    Malformed lines and texts under ``min_chars`` characters are dropped.  The parsed fields come
    out of a generator, so the filter on them stays above it and no line is parsed twice.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.select(
        "path", "position", F.inline_outer(F.array(F.from_json("value", LINE_SCHEMA, options)))
    )
    body = F.col("text")
    long_enough = F.length(tx.strip(body)) >= min_chars
    parsed = parsed.where(F.col("_corrupt").isNull() & long_enough)
    url = F.nullif(F.col("source_url"), F.lit(""))
    title = F.nullif(F.col("title"), F.lit(""))
    date = F.nullif(F.col("revision_date"), F.lit(""))
    noted = F.when(
        date.isNotNull() & ~F.contains(body, date),
        F.concat(body, F.format_string(V.REVISION_NOTE, date)),
    ).otherwise(body)
    return parsed.select(
        F.coalesce(url, F.col("path")).alias("source"),
        F.coalesce(title, paths.file_name(F.col("path"))).alias("source_label"),
        F.lit("terms").alias("doc_type"),
        F.coalesce(F.col("service_name"), F.lit("unknown")).alias("service_name"),
        F.coalesce(
            tx.lookup(F.coalesce(F.col("document_type"), F.lit("terms")), V.CRAWL_SUBTYPES),
            F.lit("unknown"),
        ).alias("doc_subtype"),
        F.coalesce(F.col("source_kind"), F.lit("web_html")).alias("source_kind"),
        noted.alias("text"),
        "position",
    )


def last_per_source(docs: DataFrame) -> DataFrame:
    """Of several lines with one source the last counts, as each replaces the one before.

    ``docs`` is read twice, so it should be a written table and not the parsing itself.
    The last position per source is a small partial aggregate; joining it back on
    (source, position) is on a unique key, so a source with many lines does not skew.
    """
    last = docs.select("source", "position").groupBy("source").agg(F.max("position").alias("position"))
    return docs.join(last, ["source", "position"], "left_semi")
