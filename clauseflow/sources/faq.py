"""FAQ files: one JSON array of question/answer objects per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.functions import paths, text as tx

_ITEMS = "array<map<string,string>>"


def parse_files(files: DataFrame) -> DataFrame:
    """(path, text) to ``items``; null where the file as a whole is rejected.

    A file counts only if it is an array of objects that all have a question and an
    answer key.
    """
    whole = F.forall(
        F.col("_items"),
        lambda i: i.isNotNull() & F.map_contains_key(i, "question") & F.map_contains_key(i, "answer"),
    )
    return files.withColumn("_items", F.from_json("text", _ITEMS)).withColumn(
        "items", F.when(F.col("_items").isNotNull() & whole, F.col("_items"))
    ).drop("_items")


def explode_items(parsed: DataFrame) -> DataFrame:
    """One row per item; the index is the place in the file, also after skipped items."""
    return (
        parsed.select(F.col("path").alias("source"), F.posexplode_outer("items").alias("chunk_index", "_item"))
        .where(F.col("_item").isNotNull())
        .select(
            "source", "chunk_index",
            F.col("_item")["question"].alias("question"),
            F.col("_item")["answer"].alias("answer"),
            F.col("_item")["category"].alias("category"),
            F.col("_item")["keywords"].alias("keywords"),
        )
    )


def faq_chunks(items: DataFrame) -> DataFrame:
    """Chunk rows of the items that have both a question and an answer."""
    question, answer = tx.strip(F.col("question")), tx.strip(F.col("answer"))
    subtype = tx.faq_subtype(F.col("category"), F.col("question"), F.col("answer"))
    return (
        items.where((question != "") & (answer != ""))
        .withColumn("doc_subtype", subtype)
        .withColumn("question", question)
        .withColumn("answer", answer)
        .withColumn("document", F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer"))
        .select(
            "source", "chunk_index", "document", "question", "answer", "doc_subtype",
            tx.chunk_id(F.col("source"), F.col("chunk_index"), F.col("document")).alias("chunk_id"),
            F.lit("faq").alias("doc_type"),
            paths.faq_service_name(F.col("source")).alias("service_name"),
            paths.file_name(F.col("source")).alias("source_label"),
            F.lit("file").alias("source_kind"),
            F.lit("service_specific").alias("scope"),
            F.lit("unknown").alias("article"),
            F.md5("document").alias("content_hash"),
        )
    )
