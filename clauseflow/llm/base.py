"""Registry of the training-data queries, scratch tables and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.session import scratch_dir, written

__all__ = ["ORACLES", "QUERIES", "components", "query", "remove", "saved", "table", "text_key", "written"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


TEXTS_AT_ONCE = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts reach Python ``TEXTS_AT_ONCE`` at a time, unless the session asks for fewer.

    Rows of Spark's own batch of 10,000 may be long; workers, and what Spark buffers for them, stay small.
    """
    if int(spark.conf.get(_BATCH)) > TEXTS_AT_ONCE:
        spark.conf.set(_BATCH, str(TEXTS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column) -> Column:
    """Equal for equal texts, null among themselves: 128 bits and the length."""
    return F.coalesce(F.concat_ws(":", F.md5(text), F.length(text).cast("string")), F.lit(""))


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared scratch folder, and its path."""
    bounded_batches(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def given_back(rows):
    """A function over batches that gives its memory back when it ends: workers are used again by what follows."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Smallest labels travel along the edges and are then looked up once more at their own
    label, so the rounds grow with the logarithm of a chain.  Each round is a written
    table; a node with very many edges is a partial minimum and a join that Spark may split.
    """
    spark = edges.sparkSession
    pairs = edges.select("a", "b").where(F.col("a") != F.col("b"))
    both, kept = saved(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    first = both.groupBy("a").agg(F.min("b").alias("b"))
    labels, path = saved(first.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        step = step.join(jump, "root", "left").select(
            "node", "old", F.least("root", F.coalesce("beyond", "root")).alias("root")
        )
        moved, new = saved(step, "labels")
        changed = moved.where(F.col("root") != F.col("old")).limit(1).count()
        remove(spark, path)
        labels, path = moved.select("node", "root"), new
        if not changed:
            remove(spark, kept)
            return labels
