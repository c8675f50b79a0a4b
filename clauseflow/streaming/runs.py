"""Answer runs replayed as their verdicts arrive: one row per run, when it ends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clauseflow import vocab as V

VERDICTS = "run_id long, ts timestamp, seq long, status string, action string"
ENDED = "run_id long, final_node string, retrievals int, verifications int, path string"
_STATE = "retrievals int, verifications int, path string, ended boolean"


def ended_runs(verdicts: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """The stream of runs that ended, from a stream of verdicts.

    verdicts(run_id, ts, seq, status, action); those of one run arrive in the order of (ts, seq)
    from batch to batch, and in any order within one.  What is kept of a run is its path so far,
    which ``max_retries`` bounds; verdicts after its end are ignored.
    """
    def follow(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        retrievals, verifications, path, ended = state.get if state.exists else (1, 0, "retrieve_context", False)
        out = []
        if not ended:
            parts = [[part[c].to_numpy() for c in ("ts", "seq", "status", "action")] for part in batches]
            ts, seq, statuses, actions = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts))
            # All that can count are the first few verdicts; no frame is built for them.
            for n in np.lexsort((seq, ts))[:max_retries + 1]:
                status, action = statuses[n], actions[n]
                path += ",generate_answer,verify_answer"
                verifications += 1
                if status == "PASS" or verifications > max_retries:
                    node = "generate_final_answer" if status == "PASS" else "generate_insufficient_evidence_answer"
                    path, ended = f"{path},{node}", True
                    out.append((key[0], node, retrievals, verifications, path))
                    break
                path += ",improve_strategy"
                if action != "REGENERATE":
                    retrievals += 1
                    path += ",retrieve_context"
            state.update((retrievals, verifications, "" if ended else path, ended))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "final_node", "retrievals", "verifications", "path"])

    # Whole microseconds: a time would be moved between zones once for every run.
    timed = verdicts.select("run_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq", "status", "action")
    return timed.groupBy("run_id").applyInPandasWithState(
        follow, ENDED, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def start(
    spark: SparkSession, root: str, target: str, checkpoint: str, max_retries: int = V.MAX_RETRIES,
    files_per_batch: int | None = None, **trigger,
) -> StreamingQuery:
    """Follows JSON files of verdicts below ``root`` and appends ended runs to the table ``target``.

    State and progress live in the checkpoint, and the file sink takes each batch once, so a
    stream that stopped goes on where it was.  By default it takes what is there and stops.
    """
    reader = spark.readStream.schema(VERDICTS).option("recursiveFileLookup", True)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        ended_runs(reader.json(root), max_retries).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", target)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
