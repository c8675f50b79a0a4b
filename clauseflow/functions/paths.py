"""Metadata that is read off a file path."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions.text import first_label


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1))


def doc_type(path: Column, kinds: Iterable[str] = V.DOC_TYPE_SEGMENTS) -> Column:
    parts = segments(path)
    picks = [F.when(F.array_contains(parts, k), F.lit(k)) for k in kinds]
    return F.coalesce(*picks, F.lit("unknown"))


def _after(path: Column, segment: str) -> Column:
    parts = segments(path)
    at = F.array_position(parts, segment)
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def service_name(path: Column, kind: Column) -> Column:
    """The folder below ``terms``; other kinds belong to no service."""
    return F.when(kind != "terms", "none").otherwise(
        F.coalesce(_after(path, "terms"), F.lit("unknown"))
    )


def faq_service_name(path: Column) -> Column:
    """The folder below ``terms`` or ``faq``; a file directly below ``faq`` has none."""
    below_faq = _after(path, "faq")
    return F.coalesce(
        _after(path, "terms"),
        F.when(below_faq != file_name(path), below_faq),
        F.lit("none"),
    )


def doc_subtype(path: Column, table: Mapping[str, Iterable[str]] = V.DOC_SUBTYPE_KEYWORDS) -> Column:
    return first_label(F.lower(file_stem(path)), table, "unknown")


def upload_subtype(path: Column, explicit: Column, kind: Column) -> Column:
    """An explicit subtype wins; unknown terms count as terms of use."""
    found = F.coalesce(F.nullif(explicit, F.lit("")), doc_subtype(path))
    return F.when((found == "unknown") & (kind == "terms"), "terms_of_use").otherwise(found)
