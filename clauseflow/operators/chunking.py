"""Documents to chunks: strategy cascade, numbering, chunk metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import articles, chunks, text as tx


def with_parts(
    docs: DataFrame,
    text: str = "text",
    doc_type: str = "doc_type",
    mode: str = "recursive",
) -> DataFrame:
    """Adds ``strategy`` and ``parts`` (array<string>): the first split that applies.

    law: articles, outline; terms: articles, outline, headings; guideline: numbered
    lines, headings; everything else, and what none of these split, goes by windows.
    A split applies when it gives at least three parts.  Each is a projection of its
    own, so its result is computed once and the next one only where it failed.
    """
    body, kind = F.col(text), F.col(doc_type)
    tried: list[str] = []

    def attempt(df: DataFrame, name: str, kinds: tuple[str, ...], split: Column) -> DataFrame:
        open_ = kind.isin(*kinds)
        for earlier in tried:
            open_ = open_ & (F.coalesce(F.size(earlier), F.lit(-1)) < V.MIN_PARTS)
        tried.append(f"_{name}")
        return df.withColumn(f"_{name}", F.when(open_, split))

    df = attempt(docs, "article", ("law", "terms"), chunks.split_before(body, chunks.BEFORE_ARTICLE))
    df = attempt(df, "outline", ("law", "terms"), chunks.split_before(body, chunks.BEFORE_OUTLINE))
    df = attempt(df, "numbered", ("guideline",), chunks.split_before(body, chunks.BEFORE_GUIDELINE))
    df = attempt(df, "heading", ("terms", "guideline"), chunks.split_headings(body))

    usable = [chunks.enough(F.col(c)) for c in tried]
    names = [F.when(F.size(c) >= V.MIN_PARTS, c[1:]) for c in tried]
    df = (
        df.withColumn("strategy", F.coalesce(*names, F.lit("window")))
        .withColumn("_parts", F.coalesce(*usable))
        .drop(*tried)
        # One pass over the arrays cuts long parts and whole texts alike.
        .withColumn("_whole", F.col("_parts").isNull())
        .withColumn("_parts", F.coalesce("_parts", F.array(tx.strip(body))))
    )
    if mode == "recursive":
        limit = F.when(F.col("_whole"), V.WINDOW_CHARS).otherwise(V.LONG_CHUNK_CHARS)
        df = df.withColumn("_parts", chunks.recut_over(F.col("_parts"), limit))
    else:
        df = df.withColumn(
            "_parts",
            F.when(F.col("_whole"), chunks.fixed_windows(F.element_at("_parts", 1)))
            .otherwise(chunks.split_long(F.col("_parts"), mode="fixed")),
        )
    parts = F.filter(F.col("_parts"), lambda p: p != "")
    return df.withColumn("parts", chunks.merge_short(parts)).drop("_parts", "_whole")


def number_parts(docs: DataFrame, source: str = "source") -> DataFrame:
    """One row per part, with its index, id, hashes and article labels.

    The outer form of explode keeps the optimizer from inferring a filter on the
    array, which it would push down and so evaluate the whole cascade twice.
    """
    return (
        docs.select("*", F.posexplode_outer("parts").alias("chunk_index", "document"))
        .drop("parts")
        .where(F.col("document").isNotNull())
        .withColumn("chunk_id", tx.chunk_id(F.col(source), F.col("chunk_index"), F.col("document")))
        .withColumn("article", articles.article_label(F.col("document")))
        .withColumn("article_no", articles.article_number(F.col("document")))
        .withColumn("content_hash", F.md5("document"))
    )
