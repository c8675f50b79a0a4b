"""Batches of user requests: validation into accepted and rejected rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import paths, text as tx


def _service_problem(name: Column) -> Column:
    return (
        F.when(F.length(F.coalesce(name, F.lit(""))) == 0, "service_missing")
        .when(F.length(name) > V.SERVICE_NAME_MAX_CHARS, "service_too_long")
        .when(tx.strip(name) == "", "service_blank")
    )


def _not_in(value: Column, allowed: Iterable[str]) -> Column:
    """Also true of a missing value."""
    return ~F.coalesce(value.isin(*allowed), F.lit(False))


def check_uploads(uploads: DataFrame, max_bytes: int = V.UPLOAD_MAX_BYTES) -> DataFrame:
    """Adds ``reject_reason`` to (service_name, document_type, file_name, n_bytes)."""
    problem = F.coalesce(
        _service_problem(F.col("service_name")),
        F.when(_not_in(F.col("document_type"), V.POLICY_SUBTYPES), "document_type"),
        F.when(_not_in(paths.file_suffix(F.col("file_name")), V.UPLOAD_SUFFIXES), "suffix"),
        F.when(F.coalesce("n_bytes", F.lit(0)) == 0, "empty_file"),
        F.when(F.col("n_bytes") > max_bytes, "file_too_large"),
    )
    return uploads.withColumn("reject_reason", problem)


def check_questions(questions: DataFrame, max_chars: int = V.QUESTION_MAX_CHARS) -> DataFrame:
    """Adds ``reject_reason`` to (service_name, question)."""
    size = F.length(F.coalesce("question", F.lit("")))
    problem = F.coalesce(
        _service_problem(F.col("service_name")),
        F.when(size == 0, "question_missing").when(size > max_chars, "question_too_long"),
    )
    return questions.withColumn("reject_reason", problem)


def check_manual(inputs: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` to pasted or extracted text (service_name, doc_type)."""
    problem = F.coalesce(
        F.when(F.coalesce(tx.strip(F.col("service_name")), F.lit("")) == "", "service_blank"),
        F.when(_not_in(F.col("doc_type"), V.MANUAL_DOC_TYPES), "doc_type"),
    )
    return inputs.withColumn("reject_reason", problem)


def explicit_urls(registry: DataFrame) -> DataFrame:
    """User URLs (service_name, kind, url): trimmed, blanks dropped, unknown kinds flagged."""
    return (
        registry.withColumn("url", tx.strip(F.col("url")))
        .where(F.col("url") != "")
        .withColumn("reject_reason", F.when(_not_in(F.col("kind"), V.POLICY_SUBTYPES), "kind"))
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull())
