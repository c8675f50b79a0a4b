"""What the store already holds for which service."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import names


def policy_status(chunks: DataFrame, kinds: Mapping[str, str] = V.POLICY_SUBTYPES) -> DataFrame:
    """One row per canonical service with a flag per policy kind; one partial aggregate."""
    held = [
        F.coalesce(F.bool_or(F.col("doc_subtype") == subtype), F.lit(False)).alias(f"has_{kind}")
        for kind, subtype in kinds.items()
    ]
    return (
        chunks.where(F.col("doc_type") == "terms")
        .groupBy(names.canonical_name(F.col("service_name")).alias("service_name")).agg(*held)
    )


def reference_status(chunks: DataFrame, required: Sequence[str] = V.REFERENCE_TYPES) -> DataFrame:
    """One row: is every reference kind present?"""
    present = [F.coalesce(F.bool_or(F.col("doc_type") == kind), F.lit(False)) for kind in required]
    both = present[0]
    for flag in present[1:]:
        both = both & flag
    return chunks.select("doc_type").agg(both.alias("reference_ready"))


def missing_kinds(kinds: Sequence[str] = tuple(V.POLICY_SUBTYPES)) -> Column:
    """Required kinds without their flag, in order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(k)) for k in kinds]))


def requested_kinds(explicit: Column, missing: Column) -> Column:
    """Explicit kinds, then the missing ones, each once."""
    return F.array_union(explicit, missing)


def readiness(services: DataFrame, chunks: DataFrame, kinds: Mapping[str, str] = V.POLICY_SUBTYPES) -> DataFrame:
    """Status of every asked (service_name), under its canonical name."""
    asked = services.select(
        names.canonical_name(F.col("service_name")).alias("service_name")
    ).where(F.col("service_name").isNotNull()).distinct()
    flags = [f"has_{k}" for k in kinds]
    status = asked.join(policy_status(chunks, kinds), "service_name", "left").withColumns(
        {f: F.coalesce(f, F.lit(False)) for f in flags}
    )
    missing = missing_kinds(tuple(kinds))
    ready = F.greatest(*flags) if len(flags) > 1 else F.col(flags[0])
    return (
        status.withColumn("missing", missing)
        .withColumn("requires_input", F.size("missing") > 0)
        .withColumn("service_ready", ready)
        .withColumn("reference_ready", reference_status(chunks).scalar())
    )


def matching_folders(services: DataFrame, folders: DataFrame) -> DataFrame:
    """(service_name) x (folder) with the same canonical name."""
    return services.withColumn("canonical", names.canonical_name(F.col("service_name"))).join(
        folders.withColumn("canonical", names.canonical_name(F.col("folder"))), "canonical"
    )


def local_successes(results: DataFrame) -> DataFrame:
    """Sources per service that went in, from (service_name, outcome)."""
    good = F.col("outcome").isin("done", "unchanged", "duplicate")
    return results.groupBy("service_name").agg(F.count_if(good).alias("succeeded"))


def first_occurrences(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Each key once, with the place of its first occurrence."""
    return rows.groupBy(*key).agg(F.min(order).alias(order))
