"""Which of very many names a text holds: one automaton over all of them, one pass over the text.

For a handful of names, literal ``contains`` conditions are as good and stay in the JVM
(``retrieval.drop_other_services``, ``names.display_name``).  Beyond that the work of a text
would grow with the number of names; here it grows with the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.session import written

BLOCK_BYTES = 32 << 20  # of names that travel to every task at once; more names take more passes


def _blocks(names: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """Distinct names that are not empty, in blocks by hash whose mean size is half the bound."""
    rows = written(names.where("name <> ''").select("name", "place").groupBy("name").agg(F.min("place").alias("place")), "names")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("name") + 64), F.lit(0))).first()[0]
    n = 1 + 2 * total // BLOCK_BYTES
    for k in range(n if total else 0):
        yield k, rows.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k)


def _searched(rows: DataFrame, names: DataFrame, text: str, own: str | None):
    """(key, place) of the first-placed name, other than the row's own, that its text holds."""
    out = rows.sparkSession.createDataFrame([], "key long, place long")
    for _, block in _blocks(names):
        shared = rows.sparkSession.sparkContext.broadcast([(r.name, r.place) for r in block.collect()])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name, place in shared.value:
                automaton.add_word(name, (place, name))
            automaton.make_automaton()
            for batch in batches:
                keys, places = [], []
                for key, said, mine in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "own"))):
                    # A missing own name says nothing about others; without the column every name counts.
                    if said and not (own and mine is None):
                        best = min((p for _, (p, name) in automaton.iter(said) if name != mine), default=None)
                        if best is not None:
                            keys.append(key)
                            places.append(best)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int64())], ["key", "place"])

        mine = F.col(own) if own else F.lit(None)
        asked = rows.select(F.col("_key").alias("key"), F.col(text).alias("text"), mine.cast("string").alias("own"))
        out = out.unionByName(asked.mapInArrow(search, "key long, place long"))
    return out.groupBy("key").agg(F.min("place").alias("place"))


def drop_rows_naming_others(rows: DataFrame, names: DataFrame, service: str = "asked_service", text: str = "document") -> DataFrame:
    """``retrieval.drop_other_services`` for a table of names(name) of any size.

    Drops rows whose text holds a name other than the one asked about; rows without a text or an
    asked service stay, empty and null names match nothing.  ``rows`` is read twice, and
    must give its rows alike both times, as a table does.
    """
    keyed = written(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = _searched(keyed, names.withColumn("place", F.lit(0).cast("long")), text, service)
    return keyed.join(found.withColumnRenamed("key", "_key"), "_key", "left_anti").drop("_key")


def with_first_name(rows: DataFrame, table: DataFrame, text: str, shown: str = "shown") -> DataFrame:
    """Adds the value of the first row of table(name, place, value) whose name the text holds, else null.

    Places are unique; of equal names the first place counts.
    """
    keyed = written(rows.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = _searched(keyed, table.withColumn("place", F.col("place").cast("long")), text, None)
    values = found.join(table.select(F.col("place").cast("long").alias("place"), F.col("value").alias(shown)), "place")
    return keyed.join(values.select(F.col("key").alias("_key"), shown), "_key", "left").drop("_key")
