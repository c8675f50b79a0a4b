"""Quality rules (5), native: line frequency across the documents of a host, and repetition.

Only DataFrame functions: words, 5-word windows and lines are arrays of their row, so
nothing but narrow line rows is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import query, saved, table, text_key

LEAST_WORDS = 10
REPEATED_PERCENT = 20
COMMON_PERCENT = 2  # of a host's distinct texts that hold a line, above which it is removed
COMMON_LEAST = 20  # texts that may always hold a line
DEPLETED_PERCENT = 50  # of a document's words in removed lines, above which it is rejected

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _positions(first: Column, last: Column) -> Column:
    """first..last, or nothing where last is below first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def with_repeats(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words`` and ``n_repeat_words``: words in 5-word windows found twice or more.

    Windows are compared by a 64-bit hash.  Only rows with an equal pair sort theirs; the
    places of repeated windows, in order, each cover what the next one leaves.
    """
    rows = rows.withColumn("_words", words_of(F.col(text)))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("_words", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn(
        "_windows",
        F.transform(
            _positions(F.lit(0), (F.col("n_words") - _WINDOW).cast("int")),
            lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(_WINDOW))),
        ),
    )
    rows = rows.withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(placed)))
    twice = F.transform(
        _positions(F.lit(0), F.size("_sorted") - 1),
        lambda j: F.when(
            F.coalesce(
                (F.get("_sorted", j)["h"] == F.get("_sorted", j - 1)["h"]), F.lit(False)
            ) | F.coalesce(F.get("_sorted", j)["h"] == F.get("_sorted", j + 1)["h"], F.lit(False)),
            F.get("_sorted", j)["i"],
        ),
    )
    rows = rows.withColumn("_places", F.when(F.col("_again"), F.sort_array(F.filter(twice, lambda p: p.isNotNull()))))
    covered = F.aggregate(
        F.transform(
            "_places", lambda p, k: F.least(F.coalesce(F.get("_places", k + 1) - p, F.lit(_WINDOW)), F.lit(_WINDOW))
        ),
        F.lit(0), lambda a, b: a + b,
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(0).cast("long"))
    return rows.drop("_words", "_windows", "_again", "_sorted", "_places")


def base_metrics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts and ``base_failed``; a null text counts as none."""
    rows = with_repeats(rows.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    return rows.select(
        "*",
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        (
            (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
        ).alias("base_failed"),
    )


def normal_lines(text: Column) -> Column:
    """(hash, words) of every line with a word: lower case, single spaces, digits as one sign."""
    line = F.lower(F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0"))
    return F.transform(
        F.filter(F.transform(F.split(line, "\n"), lambda x: F.trim(x)), lambda x: x != ""),
        lambda x: F.struct(
            F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")
        ),
    )


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    common_percent: int = COMMON_PERCENT, common_least: int = COMMON_LEAST, depleted_percent: int = DEPLETED_PERCENT,
) -> DataFrame:
    """One row per input row: id, the counts, ``base_failed``, ``n_removed_words``, ``kept``.

    A line is removed in the documents of a host if more than ``common_least`` and more than
    ``common_percent`` of the host's distinct texts hold it; copies of a text count once.  A
    document is kept unless a base rule fails or more than ``depleted_percent`` of its words
    are in removed lines.  Null is a host of its own, a null text is empty; repeated rows
    give repeated rows.  Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")
    )
    rows = base_metrics(rows).withColumn("own", F.xxhash64(text_key("text"))).withColumn("lines", normal_lines(F.col("text")))
    rows, _ = saved(rows.drop("text"), "measured")
    # Every host, line and text once: neither copies nor a line repeated in a text count twice.
    held = rows.select("host", "own", F.inline("lines")).groupBy("host", "own", "line").agg(F.max("words").alias("words"))
    texts = rows.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("holders")).where(F.col("holders") > common_least)
    common = counts.withColumnRenamed("host", "h").join(texts, F.col("h").eqNullSafe(F.col("host"))).where(
        100 * F.col("holders") > common_percent * F.col("texts")
    ).select("h", F.col("line").alias("l"))
    removed = rows.select("host", "own", F.inline("lines")).join(
        common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))
    )
    # Copies of a text in a host have the same lines: each copy's own share.
    removed = removed.groupBy(F.col("host").alias("h"), F.col("own").alias("o")).agg(F.sum("words").alias("removed"))
    copies = rows.groupBy(F.col("host").alias("ch"), F.col("own").alias("co")).agg(F.count("*").alias("copies"))
    removed = removed.join(copies, F.col("h").eqNullSafe(F.col("ch")) & (F.col("o") == F.col("co"))).select(
        "h", "o", (F.col("removed") / F.col("copies")).cast("long").alias("n_removed_words")
    )
    out = rows.join(removed, rows["host"].eqNullSafe(removed["h"]) & (rows["own"] == removed["o"]), "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_words",
        (~F.col("base_failed") & (100 * F.col("n_removed_words") <= depleted_percent * F.col("n_words"))).alias("kept"),
    )


_SQL = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, md5(coalesce(text, '')) AS own,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), lines AS (
  SELECT DISTINCT host, own, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS at,
         unnest(string_split(text, chr(10))) AS raw FROM (SELECT DISTINCT host, own, text FROM d)
), spoken AS (
  SELECT host, own, raw, trim(lower(regexp_replace(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS line
  FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), holders AS (
  SELECT host, line, count(DISTINCT own) AS n FROM spoken GROUP BY host, line
), hosts AS (
  SELECT host, count(DISTINCT own) AS texts FROM d GROUP BY host
), common AS (
  SELECT h.host, h.line FROM holders h JOIN hosts s ON h.host IS NOT DISTINCT FROM s.host
  WHERE n > {COMMON_LEAST} AND 100 * n > {COMMON_PERCENT} * texts
), removed AS (
  SELECT s.host, s.own, sum(len(string_split(s.line, ' '))) AS n_removed_words
  FROM spoken s JOIN common c ON s.host IS NOT DISTINCT FROM c.host AND s.line = c.line GROUP BY s.host, s.own
), dup AS (
  SELECT host, own, count(*) - count(DISTINCT raw) AS n_dup_lines FROM spoken GROUP BY host, own
), windows AS (
  SELECT own, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT own, any_value(words) AS words, unnest(range(1, len(any_value(words)) - 3)) AS i FROM d GROUP BY own)
), again AS (
  SELECT own, i FROM windows QUALIFY count(*) OVER (PARTITION BY own, w) > 1
), covered AS (
  SELECT own, sum(least(5, coalesce(next - i, 5))) AS n_repeat_words
  FROM (SELECT own, i, lead(i) OVER (PARTITION BY own ORDER BY i) AS next FROM again) GROUP BY own
), measured AS (
  SELECT d.*, len(words)::BIGINT AS n_words, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_removed_words, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN covered c ON d.own = c.own
  LEFT JOIN dup u ON d.own = u.own AND d.host IS NOT DISTINCT FROM u.host
  LEFT JOIN removed r ON d.own = r.own AND d.host IS NOT DISTINCT FROM r.host
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND 100 * n_removed_words <= {DEPLETED_PERCENT} * n_words AS kept
FROM judged
"""


@query(_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
