"""Structured answers: parsing, contract checks, grounding, conversion to history rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions import text as tx
from clauseflow.session import written

ANCHOR_GRAM = 12
ANCHOR_WINDOW = 9  # neighbouring grams of which the least is an anchor; texts of 20 letters have one

LISTS = (
    "terms_evidence", "source_references", "check_items", "next_actions",
    "required_materials", "follow_up_questions",
)
_STRINGS = ("problem_type", "simple_explanation", "inquiry_draft", "message")
_SCHEMA = ", ".join(f"{c} string" for c in _STRINGS + LISTS)


def _list(raw: Column) -> Column:
    """A JSON array of any scalars as strings; everything else as an empty array."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def parse_answers(answers: DataFrame, raw: str = "answer") -> DataFrame:
    """Adds the answer's fields, with defaults.  A scope message replaces the explanation.

    List fields are read as raw JSON first, so a wrong type in one of them does not
    cost the others.
    """
    parsed = answers.select("*", F.inline_outer(F.array(F.from_json(raw, _SCHEMA)))).drop(raw)
    none = F.lit("")
    return (
        parsed.withColumn("problem_type", F.coalesce(F.nullif("problem_type", none), F.lit(V.DEFAULT_PROBLEM_TYPE)))
        .withColumn("simple_explanation", F.coalesce(
            F.nullif("message", none), F.nullif("simple_explanation", none), F.lit(V.DEFAULT_EXPLANATION)
        ))
        .withColumn("inquiry_draft", F.coalesce("inquiry_draft", none))
        .withColumns({c: _list(F.col(c)) for c in LISTS})
        .withColumn("category", tx.category(F.col("problem_type")))
        .drop("message")
    )


def violations(
    answers: DataFrame,
    verdicts: Iterable[str] = V.VERDICTS,
    actions: Iterable[str] = V.ACTIONS,
    internal_path: str = V.INTERNAL_PATH_PATTERN,
    secret: str = V.SECRET_PATTERN,
) -> DataFrame:
    """One row per broken rule of (run_id, status, suggested_action, source_references, required_materials)."""
    refs = F.col("source_references")
    rules = {
        "status": ~F.col("status").isin(*verdicts),
        "suggested_action": ~F.col("suggested_action").isin(*actions),
        "repeated_reference": F.size(F.array_distinct(refs)) < F.size(refs),
        "internal_path": F.exists(refs, lambda r: r.rlike(internal_path)),
        "secret_material": F.exists("required_materials", lambda m: m.rlike(secret)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules.items()]))
    return answers.select("run_id", F.explode(broken).alias("rule"))


def grounding(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """(run_id, sentence_no, sentence) with ``grounded``: does it occur in a hit of its run?

    hits(run_id, document).  White space is ignored.  A run has at most the hits that
    retrieval ranked, so the join fans out by that small number; its result is folded
    by a partial aggregate at once.
    """
    pairs = evidence.withColumn("_sentence", tx.without_whitespace(F.col("sentence"))).join(
        hits.select("run_id", tx.without_whitespace(F.col("document")).alias("_text")), "run_id", "left"
    )
    occurs = F.coalesce(F.contains("_text", "_sentence"), F.lit(False))
    return pairs.groupBy("run_id", "sentence_no").agg(F.bool_or(occurs).alias("grounded"))


def anchors(rows: DataFrame, key: str, text: str, gram: int = ANCHOR_GRAM, window: int = ANCHOR_WINDOW) -> DataFrame:
    """(run_id, key, anchor): the anchors of every text that is long enough to have one.

    An anchor is the gram with the least hash of ``window`` neighbouring ones, so a text that
    holds another, gap by gap, has all of its anchors.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = [], []
            for k, said in enumerate(batch.column("text")):
                letters = np.frombuffer((said.as_py() or "").encode("utf-32-le"), "<u4").astype(np.uint64)
                if len(letters) < gram + window - 1:
                    continue
                hashes = np.zeros(len(letters) - gram + 1, np.uint64)
                for i in range(gram):
                    hashes = (hashes ^ letters[i : i + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15)
                    hashes ^= hashes >> np.uint64(29)
                least = hashes[: len(hashes) - window + 1].copy()
                for i in range(1, window):
                    np.minimum(least, hashes[i : i + len(least)], out=least)
                found.append(np.unique(least).astype(np.int64))
                places.append(np.full(len(found[-1]), k))
            at = pa.array(np.concatenate(places) if places else [], pa.int64())
            columns = [batch.column(c).take(at) for c in ("run_id", "key")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(found) if found else [], pa.int64())], ["run_id", "key", "anchor"]
            )

    narrow = rows.select("run_id", F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, f"run_id {kinds['run_id']}, key {kinds[key]}, anchor long").withColumnRenamed("key", key)


def anchored_pairs(evidence: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((run_id, sentence_no, hit_no), (run_id, sentence_no)): pairs to be verified, and sentences that were anchored.

    evidence(run_id, sentence_no, _sentence), hits(run_id, hit_no, _text), both without white
    space.  Of a sentence's anchors the one that fewest hits of the run have is met; if a hit has
    none of some anchor, no hit holds the sentence.
    """
    of_hits = written(anchors(hits, "hit_no", "_text"), "anchors")
    asked = written(anchors(evidence, "sentence_no", "_sentence"), "asked")
    # Only what a sentence asks for is counted.
    wanted = of_hits.join(asked.select("run_id", "anchor").distinct(), ["run_id", "anchor"], "left_semi")
    counts = wanted.groupBy("run_id", "anchor").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, ["run_id", "anchor"], "left").groupBy("run_id", "sentence_no").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("least")
    )
    met = rarest.where("least.n > 0").select("run_id", "sentence_no", F.col("least.anchor").alias("anchor"))
    return met.join(of_hits, ["run_id", "anchor"]).drop("anchor"), rarest.select("run_id", "sentence_no")


def grounding_by_anchors(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of ``grounding`` for runs with many hits: a sentence meets only hits that share its rarest anchor.

    Sentences too short for an anchor meet every hit of their run.  (run_id, sentence_no) is
    unique, as it is for ``grounding``.
    """
    said = written(evidence.select("run_id", "sentence_no", tx.without_whitespace(F.col("sentence")).alias("_sentence")), "said")
    texts = hits.select("run_id", tx.without_whitespace(F.col("document")).alias("_text"))
    texts = written(texts.withColumn("hit_no", F.monotonically_increasing_id()), "texts")
    pairs, anchored = anchored_pairs(said, texts)
    anchored = written(anchored, "anchored")
    holds = F.contains("_text", "_sentence")
    keys = ["run_id", "sentence_no"]
    verified = pairs.join(said, keys).join(texts, ["run_id", "hit_no"]).select(*keys, holds.alias("_holds"))
    short = said.join(anchored, keys, "left_anti").join(texts, "run_id").select(*keys, holds.alias("_holds"))
    found = verified.unionByName(short).where("_holds").select(*keys).distinct().withColumn("grounded", F.lit(True))
    return said.select(*keys).join(found, keys, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def grounded_share(checked: DataFrame) -> DataFrame:
    return checked.groupBy("run_id").agg(
        F.count("*").alias("sentences"),
        F.count_if("grounded").alias("grounded"),
        F.avg(F.col("grounded").cast("double")).alias("share"),
    )


def history_rows(answers: DataFrame) -> DataFrame:
    """Parsed answers (item_id, qa_id, question, ...) as question rows of the history."""
    evidence = F.nullif(F.array_join("terms_evidence", "\n\n"), F.lit(""))
    sources = F.nullif(F.array_join("source_references", "\n"), F.lit(""))
    return answers.select(
        "item_id", "qa_id", "question", "category", "problem_type",
        F.col("simple_explanation").alias("answer"),
        F.coalesce(evidence, F.lit(V.NO_EVIDENCE_TEXT)).alias("evidence"),
        F.coalesce(sources, F.lit(V.NO_SOURCE_TEXT)).alias("original_text"),
        F.col("required_materials").alias("materials"),
        F.col("inquiry_draft").alias("draft"),
        F.col("follow_up_questions").alias("follow_ups"),
        F.transform("next_actions", lambda t, i: F.struct(
            F.concat(F.lit("todo-"), i.cast("string"), F.lit("-"), F.col("qa_id").cast("string")).alias("todo_id"),
            t.alias("text"), F.lit(False).alias("checked"),
        )).alias("todo"),
    )
