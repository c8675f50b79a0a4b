"""Checked query over the streaming ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.functions import text as tx
from clauseflow.plans import shapes as S
from clauseflow.plans.registry import checked, texts
from clauseflow.plans.run_checks import VERDICTS, verdicts
from clauseflow.plans.text_checks import sql_cascade
from clauseflow.session import scratch_dir, written
from clauseflow.sources.store import ChunkStore
from clauseflow.streaming import ingest, runs


@checked(f"""
WITH RECURSIVE inputs AS (
  SELECT doc_id, doc_id % 2 AS drop_no, 'https://example.com/' || doc_id // 2 AS source, source AS service_name, text
  FROM documents WHERE doc_id % 17 <> 16 AND length({S.sql_strip('text')}) >= 200),
{S.sql_clean('inputs', 'doc_id')},
docs AS (SELECT doc_id, drop_no, source, service_name, body, {S.sql_hash('body')} AS h FROM inputs JOIN cleaned ON id = doc_id),
first_drop AS (SELECT * FROM docs WHERE drop_no = 0 QUALIFY row_number() OVER (PARTITION BY service_name, h ORDER BY doc_id) = 1),
second_drop AS (
  SELECT * FROM docs d WHERE drop_no = 1
    AND NOT EXISTS (SELECT 1 FROM first_drop f WHERE f.service_name = d.service_name AND f.h = d.h AND f.source <> d.source)
    AND NOT EXISTS (SELECT 1 FROM first_drop f WHERE f.source = d.source AND f.h = d.h)
  QUALIFY row_number() OVER (PARTITION BY service_name, h ORDER BY doc_id) = 1),
kept AS (SELECT *, 'terms' AS doc_type FROM first_drop WHERE source NOT IN (SELECT source FROM second_drop)
         UNION ALL SELECT *, 'terms' FROM second_drop),
{sql_cascade('kept', 'doc_id', 'body')},
parts AS (SELECT id, unnest(chunks) AS part, generate_subscripts(chunks, 1) - 1 AS n FROM chunked)
SELECT source, service_name, h AS document_hash, n AS chunk_index, md5(part) AS content_hash FROM parts JOIN kept ON id = doc_id""")
def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents arrive as crawl files in two drops; the second replaces and repeats sources.

    Two streams with checkpoints of their own feed one store, each one drop.
    """
    i = F.col("doc_id")
    record = F.to_json(F.struct(
        F.col("source").alias("service_name"), F.lit("terms").alias("document_type"),
        F.concat(F.lit("https://example.com/"), F.floor(i / 2).cast("string")).alias("source_url"), "text",
    ))
    lines = texts(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", F.when(i % 17 == 16, F.substring(record, 1, 30)).otherwise(record).alias("value")
    )
    inbox = scratch_dir(spark, "inbox")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    width = spark.sparkContext.defaultParallelism
    for drop in (0, 1):
        # Files and lines in the order of the ids, which decides among equal texts.
        ordered = lines.where(i % 2 == drop).repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id")
        ordered.select("value").write.format("text").save(f"{inbox}-{drop}/lines")
        ingest.start(store, f"{inbox}-{drop}", scratch_dir(spark, "stream"), glob="*.txt").awaitTermination()
    return store.read().select(
        "source", "service_name", "document_hash", F.col("chunk_index").cast("long").alias("chunk_index"), "content_hash"
    )


_ROUNDS = 4
_FILE_BYTES = 64 << 20  # of lines that one task writes


def files_of_a_round(lines: DataFrame, most: int = _FILE_BYTES) -> int:
    """Into how many files of at most about ``most`` bytes the largest round is cut."""
    sizes = lines.groupBy("round").agg(F.sum(F.octet_length("value") + 1).alias("size"))
    return 1 + (sizes.agg(F.max("size")).first()[0] or 0) // most


@checked(f"""
WITH RECURSIVE kept AS (
  SELECT doc_id, 'https://example.com/' || doc_id AS source, 's' || doc_id AS service_name, 'terms' AS doc_type,
    CASE WHEN doc_id % 3 = 0 AND doc_id % {_ROUNDS} < {_ROUNDS - 1} THEN 'Amended. ' || text ELSE text END AS text
  FROM documents WHERE length({S.sql_strip('text')}) >= 200),
{S.sql_clean('kept', 'doc_id')},
docs AS (SELECT kept.* EXCLUDE (text), body FROM kept JOIN cleaned ON id = doc_id),
{sql_cascade('docs', 'doc_id', 'body')},
parts AS (SELECT id, unnest(chunks) AS part, generate_subscripts(chunks, 1) - 1 AS n FROM chunked)
SELECT source, n AS chunk_index, md5(part) AS content_hash FROM parts JOIN docs ON id = doc_id""")
def streamed_in_small_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of files a batch, with a stop between; each batch amends some documents of the one before.

    A round is one file while it is small; all rounds have equally many, so that a batch is a round.  Small versions are folded as they come, so fewer hold the rows than there were batches.
    """
    i = F.col("doc_id")
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    first = docs.withColumn("round", i % _ROUNDS)
    again = first.where((i % 3 == 0) & (F.col("round") < _ROUNDS - 1)).withColumns(
        {"text": F.concat(F.lit("Amended. "), "text"), "round": F.col("round") + 1}
    ).where(F.length(tx.strip(F.substring("text", 10, 1 << 30))) >= 200)
    lines = written(first.union(again).select("round", F.to_json(F.struct(
        F.concat(F.lit("s"), i.cast("string")).alias("service_name"), F.lit("terms").alias("document_type"),
        F.concat(F.lit("https://example.com/"), i.cast("string")).alias("source_url"), "text",
    )).alias("value")), "lines")
    inbox, checkpoint = scratch_dir(spark, "inbox"), scratch_dir(spark, "stream")
    store = ChunkStore(spark, scratch_dir(spark, "store"))
    files = files_of_a_round(lines)
    for n in range(_ROUNDS):
        lines.where(F.col("round") == n).select("value").repartition(files).write.mode("append").format("text").save(inbox)
        if n in (_ROUNDS // 2, _ROUNDS - 1):
            ingest.start(store, inbox, checkpoint, glob="*.txt", files_per_batch=files, fold_above=2).awaitTermination()
    return store.read().select("source", F.col("chunk_index").cast("long").alias("chunk_index"), "content_hash")


@checked(f"""
WITH {VERDICTS},
ends AS (SELECT run_id, min(retry_count) FILTER (status = 'PASS' OR retry_count = 2) AS last,
                arg_min(status, retry_count) FILTER (status = 'PASS' OR retry_count = 2) AS final FROM rounds GROUP BY run_id),
steps AS (
  SELECT r.run_id, r.retry_count, 'generate_answer,verify_answer,' || CASE
      WHEN r.status = 'PASS' THEN 'generate_final_answer' WHEN r.retry_count = 2 THEN 'generate_insufficient_evidence_answer'
      WHEN r.action = 'REGENERATE' THEN 'improve_strategy' ELSE 'improve_strategy,retrieve_context' END AS step,
    (r.status <> 'PASS' AND r.retry_count < 2 AND r.action <> 'REGENERATE')::INT AS again
  FROM rounds r JOIN ends e ON r.run_id = e.run_id AND r.retry_count <= e.last)
SELECT run_id, CASE WHEN any_value(final) = 'PASS' THEN 'generate_final_answer' ELSE 'generate_insufficient_evidence_answer' END AS final_node,
  (1 + sum(again))::INT AS retrievals, count(*)::INT AS verifications, 'retrieve_context,' || string_agg(step, ',' ORDER BY retry_count) AS path
FROM steps JOIN ends USING (run_id) GROUP BY run_id""")
def streamed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict log arrives in three drops by time; the stream stops and starts again between them."""
    log = written(verdicts(spark, sf_dir), "verdicts")
    later = [(F.col("ts") >= F.lit(day)).cast("int") for day in ("2024-01-11", "2024-01-21")]
    drop = later[0] + later[1]
    inbox, target, checkpoint = (scratch_dir(spark, n) for n in ("inbox", "ended", "runs"))
    for n in range(3):
        log.where(drop == n).coalesce(2).write.mode("append").json(inbox)
        runs.start(spark, inbox, target, checkpoint).awaitTermination()
    return spark.read.schema(runs.ENDED).parquet(target)
