"""Mixing sources to target weights (10): Pareto order sampling of whole documents.

Each source's words are to be multiplied by one factor.  Its whole part is copies that every
document gets; for the rest, documents are ranked by the odds of a random number divided by
the odds of their inclusion, and those ranked first are taken while their words stay within
what is missing; one more, the one that fits best, fills the rest.  Inclusion leans to longer documents, by a tilt that leaves the expected
words as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.llm.base import query, saved, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
RANK_ROWS = 4_000  # rows of a source in which the cut is looked for one by one, about

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def told_apart(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row; rows that are not equal in all columns have others."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(F.lit(""), *(c.isNull().cast("int").cast("string") for c in columns))
    return F.xxhash64(F.lit(1), nulls, *columns), F.xxhash64(F.lit(2), nulls, *columns)


def chance(seed: str) -> Column:
    """A number between 0 and 1 that depends on the row and its number among equal ones alone."""
    name = F.concat_ws(":", F.lit(seed), "one", "two", "number")
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def with_chance(rows: DataFrame, repeated: DataFrame, seed: str) -> DataFrame:
    """Adds ``chance`` to rows (.., one, two); ``repeated`` are the (one, two) of several rows.

    Equal rows are numbered from 1, so they do not all come or stay out together.  Which of
    them has which number makes no difference; a group of very many is numbered where its
    rows were read, part by part.
    """
    if not repeated.limit(1).count():
        return rows.withColumn("number", F.lit(1)).withColumn("chance", chance(seed)).drop("number")
    marked = rows.withColumn("_part", F.spark_partition_id()).join(repeated.withColumn("_many", F.lit(True)), ["one", "two"], "left")
    more, _ = saved(marked.where("_many").drop("_many"), "repeated")
    counts = more.groupBy("one", "two", "_part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("one", "two").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("one", "two", "_part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("one", "two", "_part").orderBy("size")
    more = more.withColumn("number", F.row_number().over(inside)).join(starts, ["one", "two", "_part"])
    more = more.withColumn("number", (F.col("number") + F.col("_start")).cast("int")).drop("_start", "_part")
    once = marked.where("_many is null").drop("_many", "_part").withColumn("number", F.lit(1))
    return once.unionByName(more).withColumn("chance", chance(seed)).drop("number")


def _sized(docs: DataFrame, text_col: str, source_col: str) -> list[Column]:
    one, two = told_apart(docs)
    return [F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), one.alias("one"), two.alias("two")]


def _repeated(narrow: DataFrame) -> DataFrame:
    """(one, two) of rows that come more than once, as a written table."""
    return saved(narrow.groupBy("one", "two").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "repeated_keys")[0]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all words; a target stops at ``most`` times its source's words and the excess is
    shared again.  That is one level for all sources, found where the sources sorted by
    their own stop turn from stopped to free.  The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1))
    rows = rows.withColumn("stop", F.col("source_size") * most).withColumn("ratio", F.col("stop") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier, later = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("stop").over(earlier), F.lit(0)))
        / F.sum("weight").over(later),
    )
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    level = F.coalesce(F.min(free).over(everything)["level"], F.col("ratio"))
    return rows.select(
        "source", "source_size", F.least(F.col("stop").cast("double"), level * F.col("weight")).alias("target")
    )


def lean(size: str) -> Column:
    """From -1000 to 1000: how much longer than its source's mean a document is."""
    return F.when(
        F.col(size) + F.col("mean") > 0, F.floor(1000 * (F.col(size) - F.col("mean")) / (F.col(size) + F.col("mean")))
    ).otherwise(0).cast("long")


def place_in_order(size: str, chance_col: str) -> Column:
    """Between 0 and 1, rising with random odds divided by inclusion odds."""
    tilt = 0.25 * F.least("rest", 1 - F.col("rest")) * (lean(size) - F.col("lean")) / 1000
    odds = F.col(chance_col) / (1 - F.col(chance_col)) * (1 - F.col("rest") - tilt) / (F.col("rest") + tilt)
    return F.when(F.col("rest") > 0, odds / (1 + odds))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: its words and target, the copies all get, and the places to which one more is due.

    ``rows`` are (source, size, chance).  A source's cut is found from words summed by place
    in steps, and row by row only within the step that holds it.
    """
    base = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    base, _ = saved(targets(base, weights, share, most).join(
        base.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s"), "targets")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = base.withColumn("mean", F.floor(F.col("source_size") / F.col("docs"))).withColumn("factor", factor)
    base = base.withColumn("whole", F.floor("factor")).withColumn("rest", F.col("factor") - F.col("whole"))
    leaning = with_source(rows, base.select("source", "mean")).groupBy("source").agg(
        F.sum(lean("size") * F.col("size")).alias("leant"), F.sum("size").alias("of")
    )
    base = with_source(base, leaning).withColumn(
        "lean", F.when(F.col("of") > 0, F.col("leant") / F.col("of")).otherwise(F.lit(0.0))
    ).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")).drop("leant", "of")
    base, _ = saved(base, "sources")

    steps = rows.count() // RANK_ROWS + 64
    placed = with_source(rows, base).where("rest > 0 and size > 0").withColumn("place", place_in_order("size", "chance"))
    placed = placed.select("source", "size", "place", "missing", F.floor(F.col("place") * steps).cast("long").alias("step"))
    sums = placed.groupBy("source", "step", "missing").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("step")
    sums = sums.withColumn("upto", F.sum("words").over(upto)).where(
        (F.col("upto") >= F.col("missing")) & (F.col("upto") - F.col("words") < F.col("missing"))
    )
    held = sums.select(F.col("source").alias("_s"), F.col("step").alias("_t"), (F.col("upto") - F.col("words")).alias("before"))
    near = placed.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.col("step") == F.col("_t")))
    inside = Window.partitionBy("source", "step").orderBy("place", "size")
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(inside))
    fits = F.when(F.col("upto") <= F.col("missing"), F.struct("upto", "place"))
    cuts = near.groupBy("source").agg(
        F.max(fits).alias("last"), F.min("before").alias("before"), F.min("step").alias("step")
    ).select(
        "source", F.coalesce("last.place", F.col("step") / F.lit(float(steps))).alias("cut"),
        F.coalesce("last.upto", "before").alias("have"),
    )
    # Written, as all tables by source are: Spark sees that they are small, and no source's rows are gathered.
    cuts, _ = saved(cuts, "cuts")
    # One more document: of those behind the cut the one that comes nearest, if any does.
    behind = with_source(placed, cuts).where(F.col("place") > F.col("cut"))
    left = F.col("missing") - F.col("have")
    off = F.abs(F.col("size") - left)
    extra = behind.where(off < left).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place")).alias("best"))
    cuts = with_source(cuts, extra.select("source", F.col("best.place").alias("extra")), "left")
    return saved(with_source(base, cuts, "left"), "plan")[0]


def with_source(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    other = other.withColumnRenamed("source", "_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def copies(size: str, chance_col: str) -> Column:
    """How often a document comes, given its source's plan."""
    place = place_in_order(size, chance_col)
    due = (place <= F.col("cut")) | F.coalesce(place == F.col("extra"), F.lit(False))
    one = F.coalesce(due & (F.col(size) > 0), F.lit(False))
    return (F.col("whole") + one.cast("int")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per input row: id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Size is the number of words; null and empty texts have none and take none.  Null is a
    source of its own.  The random number comes from the whole row, its number among
    rows equal to it, and the seed: reruns agree, and rows that share an id, or have none,
    are chosen apart.  Other columns only tell rows apart; no rows give no rows.
    """
    rows, _ = saved(docs.select(F.col(id_col).alias("doc"), *_sized(docs, text_col, source_col)), "sized")
    rows = with_chance(rows, _repeated(rows), seed)
    plan = mix_plan(rows.select("source", "size", "chance"))
    out = with_source(rows, plan).withColumn("copies", copies("size", "chance"))
    return out.select(
        F.col("doc").alias(id_col), "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents, each as often as the mix takes it; all their columns stay, whatever their names.

    Decisions are those of ``mix``, also for nulls, ties and repeated rows.  The plan, a row per
    source, is written and small, so it travels to the texts, which stay where they are read.
    """
    names = docs.columns
    narrow, _ = saved(docs.select(*_sized(docs, text_col, source_col)), "sized")
    repeated = _repeated(narrow)
    plan = mix_plan(with_chance(narrow, repeated, seed).select("source", "size", "chance"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), *_sized(docs, text_col, source_col))
    rows = with_chance(rows, repeated, seed)
    chosen = with_source(rows, plan.select("source", "mean", "whole", "rest", "lean", "cut", "extra"))
    chosen = chosen.select("_row", copies("size", "chance").alias("copies")).where("copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


@query()
def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
