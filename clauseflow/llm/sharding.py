"""Sharding (1): indivisible groups of equal texts packed into shards by best fit decreasing.

Groups enter by falling size; each goes to the shard with the least room that still holds
it, found in a balanced tree of the rooms.  Groups of one size are alike to best fit, which
puts as many of them as it can into the shard it took for the first: so the packing needs
only how many groups there are of each size, and gives runs of groups in a row.  Of d sizes
the least is 1 and no two are equal, so d * (d + 1) / 2 is at most the bytes packed: 250,000
sizes for 30 GB and 14 million for 100 TB at the very most.  Groups get their shard on Spark,
by their number among those of their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseflow.llm.base import query, remove, saved, table, text_key

SHARDS = 16
PART_ROWS = 5_000
HEAVY = 65_536  # a group with more than so small a part of all rows has its shard broadcast
SLACK = 20_000  # the capacity is found to one part in so many


class RoomTree:
    """(room, shard) pairs in order: a two-level search tree whose leaves split when full."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.highest: list[tuple[int, int]] = []  # of every leaf but the last

    def add(self, pair: tuple[int, int]) -> None:
        k = bisect_left(self.highest, pair)
        leaf = self.leaves[k]
        insort(leaf, pair)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.highest.insert(k, leaf[half - 1])

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the pair of least room that holds ``size``."""
        key = (size, -1)
        for k in range(bisect_left(self.highest, key), len(self.leaves)):
            leaf = self.leaves[k]
            at = bisect_left(leaf, key)
            if at < len(leaf):
                return leaf.pop(at)
        return None


# (size, number of groups of that size), sizes falling.
Classes = list[tuple[int, int]]
# (size, first and last of its groups in a row, counted from 0, their shard).
Runs = list[tuple[int, int, int, int]]


def best_fit_runs(classes: Classes, capacity: int, most: int | None = None) -> Runs | None:
    """The shards of all groups by best fit decreasing; None if it takes more than ``most``.

    What exceeds the capacity gets a shard of its own, which takes nothing else.
    """
    tree, runs, opened = RoomTree(), [], 0
    for size, count in classes:
        at = 0
        while at < count:
            found = tree.take(size)
            if found is None:
                if opened == most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, shard = found
            # With one more group in it, the tightest shard is still the tightest that holds the next.
            taken = min(count - at, room // size)
            runs.append((size, at, at + taken - 1, shard))
            at += taken
            if room > taken * size:
                tree.add((room - taken * size, shard))
    return runs


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The shard of each size, given from largest to smallest."""
    runs = best_fit_runs([(size, len([*same])) for size, same in groupby(sizes)], capacity)
    return [shard for _, first, last, shard in runs for _ in range(first, last + 1)]


def least_capacity(classes: Classes, shards: int) -> tuple[int, Runs]:
    """(the smallest capacity found with which the groups need at most ``shards``, their runs)."""
    if not classes:
        return 1, []
    low = max(-(-sum(size * count for size, count in classes) // shards), classes[0][0])
    high, packed = low, best_fit_runs(classes, low, shards)
    step = max(1, low // SLACK)
    while packed is None:
        low, high = high, high + step
        step *= 2
        packed = best_fit_runs(classes, high, shards)
    while high - low > max(1, low // SLACK):
        middle = (low + high) // 2
        tried = best_fit_runs(classes, middle, shards)
        if tried is None:
            low = middle
        else:
            high, packed = middle, tried
    return high, packed


def measured(text_col: str = "text") -> tuple:
    """(key of equal texts, null as empty; bytes plus 1) as columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return text_key(text), (F.octet_length(text) + 1).cast("long")


def numbered(rows: DataFrame, by: str, order: list[str], parts: int, out: str) -> DataFrame:
    """Numbers the rows of each ``by`` from 0 without gaps, in ``parts`` parts by the hash of
    the ``order``, so no ``by`` is numbered in one task."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy(by, "_part").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_part").orderBy(*order)
    rows = rows.withColumn(out, F.row_number().over(inside)).join(starts, [by, "_part"])
    return rows.withColumn(out, (F.col("_start") + F.col(out) - 1).cast("long")).drop("_part", "_start")


def packing(docs: DataFrame, text_col: str = "text", shards: int | None = SHARDS, capacity: int | None = None) -> tuple[DataFrame, int]:
    """(every group's key, ``copies`` and ``shard``; the copies that make a group heavy) for ``place``.

    With a ``capacity`` as many shards as it needs; else the least capacity for ``shards``.
    No shard exceeds the capacity but by a group that does so alone.  No rows give no groups.
    """
    spark = docs.sparkSession
    key, size = measured(text_col)
    groups = docs.select(key.alias("key"), size.alias("size")).groupBy("key")
    groups, at_groups = saved(groups.agg(F.sum("size").alias("size"), F.count("*").alias("copies")), "groups")
    found = groups.groupBy("size").agg(F.count("*").alias("m"), F.sum("copies").alias("rows")).toArrow()
    counted = list(zip(found.column("size").to_pylist(), found.column("m").to_pylist()))
    classes = sorted(counted, reverse=True)
    runs = best_fit_runs(classes, capacity) if capacity else least_capacity(classes, shards)[1]
    # A run has a row for each part of its size that it touches, so the join is on equal parts.
    kinds = pa.schema([("size", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("shard", pa.int32())])
    columns = zip(*runs) if runs else [()] * len(kinds)
    runs = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))
    touched = F.sequence(F.floor(F.col("first") / PART_ROWS), F.floor(F.col("last") / PART_ROWS))
    runs = runs.withColumn("part", F.explode(touched))
    ranked = numbered(groups, "size", ["key"], max((m for _, m in classes), default=0) // PART_ROWS + 1, "rank")
    items = ranked.withColumn("part", F.floor(F.col("rank") / PART_ROWS)).join(runs, ["size", "part"])
    items, _ = saved(items.where("rank between first and last").select("key", "copies", "shard"), "items")
    remove(spark, at_groups)
    return items, sum(found.column("rows").to_pylist()) // HEAVY + 2


def _placed(rows: DataFrame, items: DataFrame, heavy: int) -> DataFrame:
    """The rows (``_key``, ...) with their ``_shard``: at most HEAVY groups, those with ``heavy``
    copies or more, are looked up in a broadcast table, all others by a join in which no key
    has as many rows."""
    large = items.where(F.col("copies") >= heavy).select(F.col("key").alias("_key"), F.col("shard").alias("_large"))
    small = items.where(F.col("copies") < heavy).select(F.col("key").alias("_rest"), F.col("shard").alias("_small"))
    rows = rows.join(F.broadcast(large), "_key", "left")
    # Rows that have their shard go through the join under keys of their own, in no one task.
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_rest", F.when(F.col("_large").isNull(), F.col("_key")).otherwise(own))
    rows = rows.join(small, "_rest", "left")
    return rows.withColumn("_shard", F.coalesce("_large", "_small")).drop("_key", "_rest", "_large", "_small")


def place(docs: DataFrame, items: DataFrame, heavy: int, text_col: str = "text", out: str = "shard") -> DataFrame:
    """The documents with their shard, from what ``packing`` gave for the same documents.

    Equal texts, null and empty ones among them, have one shard; repeated rows all stay.  All
    columns stay, whatever their names: where one is called ``out``, the shard's own has
    underscores behind that.  No rows give no rows.
    """
    while out in docs.columns:
        out += "_"
    key, _ = measured(text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), key.alias("_key"))
    return _placed(rows, items, heavy).select("_row.*", F.col("_shard").alias(out))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Size is the text's UTF-8 bytes plus 1.  Rows of equal text (null and the empty text
    count as equal) are never parted; a group above the capacity fills a shard alone.  Slots
    count from 0 in every shard without gaps, by parts of about ``PART_ROWS`` rows, so no
    shard is numbered in one task.  Repeated rows get slots of their own.  Other columns
    are not read; an empty table gives no rows.
    """
    items, heavy = packing(docs, text_col, shards)
    key, size = measured(text_col)
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), size.alias("size"), crc.alias("crc"))
    rows, _ = saved(_placed(rows, items, heavy).withColumnRenamed("_shard", "shard"), "placed")
    slots = numbered(rows, "shard", ["_id", "crc", "size"], rows.count() // (shards * PART_ROWS) + 1, "slot")
    return slots.select(F.col("_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
