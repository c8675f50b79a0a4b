"""Answer runs: routing, retries, round logs and replay over verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow import vocab as V


def route_scope(in_scope: Column) -> Column:
    return F.when(in_scope, "retrieve_context").otherwise("generate_out_of_scope_answer")


def route_verdict(status: Column, retry_count: Column, max_retries: int = V.MAX_RETRIES) -> Column:
    return (
        F.when(status == "PASS", "generate_final_answer")
        .when(retry_count >= max_retries, "generate_insufficient_evidence_answer")
        .otherwise("improve_strategy")
    )


def route_improvement(action: Column) -> Column:
    """Only REGENERATE keeps the evidence; anything else searches again."""
    return F.when(action == "REGENERATE", "generate_answer").otherwise("retrieve_context")


def apply_improvement(runs: DataFrame, instructions: DataFrame) -> DataFrame:
    """Failing runs go into the next round with their new instruction; others are unchanged."""
    failing = route_verdict(F.col("status"), F.col("retry_count")) == "improve_strategy"
    return (
        runs.join(instructions.withColumnRenamed("instruction", "_new"), "run_id", "left")
        .withColumn("_fails", failing)
        .withColumn("retry_count", F.col("retry_count") + F.col("_fails").cast("int"))
        .withColumn(
            "instruction", F.when(F.col("_fails"), F.coalesce("_new", "instruction")).otherwise(F.col("instruction"))
        )
        .drop("_new", "_fails")
    )


def log_rows(runs: DataFrame, stage: str, *details: str, preview_chars: int = V.PREVIEW_CHARS) -> DataFrame:
    """Round-log rows of one stage; contexts are kept as a preview."""
    wide = [
        F.substring(c, 1, preview_chars).alias(f"{c}_preview") if c.endswith("_context") else F.col(c)
        for c in details
    ]
    return runs.select("run_id", F.lit(stage).alias("stage"), "retry_count", *wide)


def append_logs(log: DataFrame, *more: DataFrame) -> DataFrame:
    for rows in more:
        log = log.unionByName(rows, allowMissingColumns=True)
    return log


def rounds(verdicts: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """(run_id, ts, seq, status, action): the verdicts of each run that can still matter.

    A run ends by its (max_retries + 1)-th verdict at the latest, so no task needs
    more of a run than that, whatever its log holds.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "seq"))
    return verdicts.withColumn("_n", place).where(F.col("_n") <= max_retries + 1).withColumn(
        "retry_count", F.col("_n") - 1
    ).drop("_n")


def replay(runs: DataFrame, verdicts: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """Final node and stage counts of every run, from its scope flag and verdicts.

    runs(run_id, in_scope).  A log that stops before the end of its run leaves
    ``final_node`` at 'unfinished'.
    """
    places = range(max_retries + 1)
    per_run = rounds(verdicts, max_retries).groupBy("run_id").agg(*[
        F.max(F.when(F.col("retry_count") == i, F.struct("status", "action"))).alias(f"_v{i}") for i in places
    ])
    df = runs.join(per_run, "run_id", "left")
    final = F.lit("unfinished")
    seen = F.lit(0)          # verdicts that were reached
    searches, steps = F.lit(1), F.lit("retrieve_context")
    searched: list[Column] = []
    path: list[Column] = [F.lit("retrieve_context")]
    reached = F.lit(True)
    for i in places:
        verdict = F.col(f"_v{i}")
        here = reached & verdict.isNotNull()
        node = route_verdict(verdict["status"], F.lit(i), max_retries)
        seen = seen + F.when(here, 1).otherwise(0)
        ends = here & (node != "improve_strategy")
        final = F.when(ends, node).otherwise(final)
        path.append(F.when(here, F.lit("generate_answer,verify_answer")))
        path.append(F.when(ends, node))
        goes_on = here & (node == "improve_strategy")
        back = route_improvement(verdict["action"])
        again = goes_on & (back == "retrieve_context")
        searched.append(F.when(again, 1).otherwise(0))
        path.append(F.when(goes_on, F.when(again, "improve_strategy,retrieve_context").otherwise("improve_strategy")))
        reached = goes_on
    for extra in searched:
        searches = searches + extra
    inside = F.col("in_scope")
    return df.select(
        "run_id", "in_scope",
        F.when(inside, final).otherwise("generate_out_of_scope_answer").alias("final_node"),
        F.when(inside, searches).otherwise(0).alias("retrievals"),
        F.when(inside, seen).otherwise(0).alias("verifications"),
        F.when(inside, F.concat_ws(",", *path)).otherwise("generate_out_of_scope_answer").alias("path"),
    )


def stage_counts(log: DataFrame) -> DataFrame:
    """Retrievals, generations and verifications per run; one partial aggregate."""
    return log.groupBy("run_id").agg(
        F.count_if(F.col("stage") == "retrieve_context").alias("retrievals"),
        F.count_if(F.col("stage") == "generate_answer").alias("generations"),
        F.count_if(F.col("stage") == "verify_answer").alias("verifications"),
    )


def out_of_scope_answers(runs: DataFrame, product: str = "이 서비스") -> DataFrame:
    """The fixed message for every run outside the scope."""
    return runs.where(~F.col("in_scope")).select(
        "run_id", F.lit(V.OUT_OF_SCOPE_TEXT % product).alias("message")
    )
