"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What Python sees of a table at once.  Long texts end a batch earlier than their number does.
ROWS_TO_PYTHON = 1_000
BYTES_TO_PYTHON = 4 << 20
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_TO_PYTHON,
    "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_TO_PYTHON,
}


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of bounded size, so that workers stay small; a session may ask for smaller ones."""
    for key, most in _BATCHES.items():
        asked = spark.conf.get(key, None)
        size = int(asked.rstrip("bB")) if asked and asked.rstrip("bB").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def build_session(app: str = "clauseflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    Shuffle width is left to AQE: it starts wide and is coalesced by size, so the
    same code runs on eight local cores and on a thousand executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key: str(most) for key, most in _BATCHES.items()},
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores: one shuffle, whatever the size.

    For wide per-row work on a table of few large files.  A table with many files has
    splits enough and needs none of it.
    """
    bounded_batches(df.sparkSession)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch location and read back.

    Cuts the lineage: what follows reads a table instead of computing the rows again,
    also after an executor was lost.
    """
    bounded_batches(df.sparkSession)
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder of its own; on a cluster
    it is an error, as each machine would write to its own disk.
    """
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def _scratch_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="clauseflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, "clauseflow", spark.sparkContext.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; for the end of a job, when its results are stored."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(root, True)
