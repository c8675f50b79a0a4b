"""Deciding which sources of a batch are stored, and applying them to a store.

A batch is judged against the store as it was when the batch began; among new
documents with one (service, hash) the first source in path order wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import text as tx
from clauseflow.operators import chunking

DOC_KEYS = ("source", "service_name", "document_hash", "ingest_schema_version")


def prepare(docs: DataFrame) -> DataFrame:
    """Adds cleaned ``body``, ``document_hash`` and ``scope`` to documents that have text."""
    return (
        docs.withColumn("body", tx.clean_text(F.col("text")))
        .withColumn("document_hash", tx.document_hash(F.col("body")))
        .withColumn("scope", tx.scope(F.col("body")))
        .drop("text")
    )


def stored_documents(rows: DataFrame) -> DataFrame:
    """One row per stored document, from the store's documents or from its chunks."""
    return rows.select(*DOC_KEYS).distinct()


def documents_exist(
    services: DataFrame, chunks: DataFrame, subtype: str | None = None
) -> DataFrame:
    """The (service_name) rows that have stored terms, optionally of one subtype."""
    stored = chunks.where(F.col("doc_type") == "terms")
    if subtype is not None:
        stored = stored.where(F.col("doc_subtype") == subtype)
    # Distinct first: a service may hold a large share of the store.
    return services.join(stored.select("service_name").distinct(), "service_name", "left_semi")


def unchanged(batch: DataFrame, stored: DataFrame, version: int = V.INGEST_SCHEMA_VERSION) -> DataFrame:
    """Sources stored with the same hash under the current schema version."""
    current = stored.where(F.col("ingest_schema_version") == version)
    return batch.join(current, ["source", "document_hash"], "left_semi")


def winners(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """For each (service, hash) of the batch the one source that may be stored, if any.

    With no stored copy that is the first of the batch, by ``position`` where it has one and
    else by source; with one stored copy only that
    source itself; with several, none.  Both sides are partial aggregates, so a text
    that was copied a billion times shuffles as one row per task, and a later join
    can use the unique ``source``.
    """
    keys = ["service_name", "document_hash"]
    first = F.min("source") if "position" not in batch.columns else F.min_by("source", F.struct("position", "source"))
    new = batch.groupBy(*keys).agg(first.alias("_first"))
    # Only what the batch asks for is gathered, however large the store is.
    old = stored.join(new.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("source").alias("_low"), F.max("source").alias("_high"))
    winner = F.when(F.col("_low").isNull(), F.col("_first")).when(
        F.col("_low") == F.col("_high"), F.col("_low")
    )
    return new.join(old, keys, "left").select(*keys, winner.alias("source")).where(F.col("source").isNotNull())


def judge(batch: DataFrame, stored: DataFrame, version: int = V.INGEST_SCHEMA_VERSION) -> DataFrame:
    """Adds ``outcome``: new, unchanged, duplicate or empty.

    ``batch`` has one narrow row per source: source, service_name and document_hash
    (null for blank text), and optionally ``position``.  It is read twice, so it should be a written table and not
    the hashing itself.  All joins include the unique source, so copies skew none.
    """
    hashed = batch.where(F.col("document_hash").isNotNull())
    best = winners(hashed, stored).withColumn("_wins", F.lit(True))
    same = (
        stored.where(F.col("ingest_schema_version") == version)
        .join(hashed.select("source", "document_hash"), ["source", "document_hash"], "left_semi")
        .select("source", "document_hash", F.lit(True).alias("_same")).distinct()
    )
    outcome = (
        F.when(F.col("document_hash").isNull(), "empty")
        .when(F.col("_same"), "unchanged")
        .when(F.col("_wins"), "new")
        .otherwise("duplicate")
    )
    return (
        batch.join(same, ["source", "document_hash"], "left")
        .join(best, ["source", "service_name", "document_hash"], "left")
        .withColumn("outcome", outcome)
        .drop("_wins", "_same")
    )


def hashes(docs: DataFrame) -> DataFrame:
    """The narrow rows that ``judge`` takes."""
    blank = tx.is_blank(F.col("text"))
    digest = F.when(~blank, tx.document_hash(tx.clean_text(F.col("text"))))
    order = [c for c in ("position",) if c in docs.columns]
    return docs.select("source", "service_name", digest.alias("document_hash"), *order)


def hashes_of_prepared(docs: DataFrame) -> DataFrame:
    """The rows of ``hashes`` from documents that ``prepare`` has cleaned and hashed."""
    return docs.select("source", "service_name", F.when(F.col("body") != "", F.col("document_hash")).alias("document_hash"))


def chunk_rows(docs: DataFrame, mode: str = "recursive") -> DataFrame:
    """Chunk rows with all metadata for the prepared documents that go into the store."""
    parts = chunking.with_parts(docs, "body", "doc_type", mode).drop("body", "strategy")
    return (
        chunking.number_parts(parts)
        .withColumn("ingest_schema_version", F.lit(V.INGEST_SCHEMA_VERSION))
        .withColumn("updated_at", F.current_timestamp())
    )


def outcomes(judged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Final outcome per source: done / unchanged / duplicate / empty / no_chunks."""
    counts = chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))
    n = F.coalesce("n_chunks", F.lit(0))
    final = F.when(F.col("outcome") != "new", F.col("outcome")).otherwise(
        F.when(n > 0, "done").otherwise("no_chunks")
    )
    return judged.join(counts, "source", "left").select(
        "source", "service_name", final.alias("outcome"), n.alias("n_chunks")
    )


def upsert(store: DataFrame, new_chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The store with all chunks of the given sources replaced by the new ones."""
    gone = (new_chunks if sources is None else sources).select("source").distinct()
    return store.join(gone, "source", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def stale_sources(store: DataFrame, current: DataFrame) -> DataFrame:
    """File sources of the store that are no longer listed under any root."""
    files = store.where(F.col("source_kind") == "file").select("source").distinct()
    return files.join(current.select("source"), "source", "left_anti")


def sweep(store: DataFrame, current: DataFrame) -> DataFrame:
    """The store without chunks of vanished files; other kinds of source are kept.

    A left anti join on (source, kind) keeps this one pass over the store.
    """
    listed = current.select("source").distinct().withColumn("_listed", F.lit(True))
    return (
        store.join(listed, "source", "left")
        .where((F.col("source_kind") != "file") | F.col("_listed"))
        .drop("_listed")
    )


def summary(results: DataFrame) -> DataFrame:
    """Successes, failures, sources and chunks; skipped sources count as successes."""
    good = F.col("outcome").isin("done", "unchanged", "duplicate")
    return results.agg(
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.count("*").alias("sources"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("new_chunks"),
    )


def needs_ocr(pages: DataFrame, max_blank_share: float = 0.7) -> DataFrame:
    """(doc_id, text) page rows to one row per document: is its text layer missing?"""
    blank = F.count_if(tx.is_blank(F.col("text")))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        blank.alias("blank_pages"),
        ((blank == F.count("*")) | (blank / F.count("*") > max_blank_share)).alias("needs_ocr"),
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) to one text per document: its pages that are not blank, in order.

    A document's own pages are gathered, never those of several.
    """
    ordered = F.array_sort(F.collect_list(F.when(
        ~tx.is_blank(F.col("text")), F.struct("page_no", F.concat("text", F.lit("\n")).alias("t"))
    )))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "").alias("text"))


def paged_documents(
    pages: DataFrame, recognised: DataFrame, script: str = V.HANGUL, min_chars: int = 100, min_share: float = 0.1
) -> DataFrame:
    """(doc_id, text, reject_reason) of documents that come as page rows.

    The text layer counts unless most of its pages are blank; then the recognised pages
    do, if they are readable; else the document is rejected.
    """
    layer = page_texts(pages).join(needs_ocr(pages).select("doc_id", "needs_ocr"), "doc_id")
    seen = page_texts(recognised).withColumnRenamed("text", "_seen")
    readable = F.coalesce(tx.is_readable(F.col("_seen"), script, min_chars, min_share), F.lit(False))
    text = F.when(~F.col("needs_ocr"), F.col("text")).when(readable, F.col("_seen"))
    return layer.join(seen, "doc_id", "left").select(
        "doc_id", text.alias("text"), F.when(text.isNull(), "unreadable").alias("reject_reason")
    )
