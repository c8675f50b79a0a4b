"""Incremental ingest: crawl files go into the chunk store as they arrive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clauseflow.plans import jobs
from clauseflow.session import bounded_batches
from clauseflow.sources import crawl
from clauseflow.sources.store import FOLD_ABOVE, ChunkStore


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark wrote into a checkpoint when its stream first started."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def start(
    store: ChunkStore, root: str, checkpoint: str, name: str = "crawl", glob: str = "*.jsonl",
    embed: jobs.Embed | None = None, files_per_batch: int | None = None, clean: str | None = None,
    fold_above: int = FOLD_ABOVE, **trigger,
) -> StreamingQuery:
    """Starts the stream; by default it takes what is there and stops.

    A batch carries the stream's own id, which its checkpoint keeps, and its number into the
    store's commit.  If the job dies between that commit and the stream's checkpoint, the
    batch comes again and is skipped.  Any number of streams may feed one store.  A batch takes
    up to ``files_per_batch`` files; files that are done are deleted with ``clean="delete"``, or moved
    below the folder ``clean``.  When more than ``fold_above`` versions hold the store's rows, the
    small ones are written together, so a long stream does not leave a folder for each batch.
    """
    bounded_batches(store.spark)  # the stream keeps the settings it starts with, whatever was set since the store was made
    options = {} if files_per_batch is None else {"maxFilesPerTrigger": str(files_per_batch)}
    if clean == "delete":
        options["cleanSource"] = "delete"
    elif clean is not None:
        options |= {"cleanSource": "archive", "sourceArchiveDir": clean}

    def apply(lines: DataFrame, number: int) -> None:
        txn = f"{stream_id(store.spark, checkpoint)}:{number}"
        if not store.has_transaction(txn):
            jobs.ingest_crawl(store, crawl.with_positions(lines), txn, embed)
        store.fold(fold_above)

    return (
        crawl.read_lines(store.spark, root, stream=True, glob=glob, **options)
        .writeStream.foreachBatch(apply)
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
