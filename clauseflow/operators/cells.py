"""Exact nearest neighbours without all pairs: metric cells and the triangle inequality.

Chunk vectors carry the nearest of some centres (``cell``) and their distance to it
(``cell_distance``) as stored columns.  A cell of a scope is then known by its size and by
the least and greatest of those distances, so no chunk of it can be nearer to a question
than the question's distance to the centre allows.  A question first meets the cells
around it that hold enough chunks; the pool it finds there bounds what it still needs, and a
second round goes through all cells that may hold something nearer, in parts of bounded size, so
that a vector travels at most once to each part however many cells it meets.  The
rows are those of ``retrieval.nearest``; centres decide how much is compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from clauseflow.operators import blocks, retrieval as R
from clauseflow.session import written

MOST_CELLS = 1024
SAMPLE_ROWS = 200_000  # rows the centres are fitted on, about; every row is indexed
ROUNDS = 5
NO_CELL = -1  # of vectors stored before there were centres: always met
VISITORS = 2_000  # questions that choose their cells at once
_MARGIN = 1e-9  # for the rounding of distances, relative


@dataclass(frozen=True)
class Cells:
    """Centres as rows; at most ``MOST_CELLS`` of them, so they travel with a query."""

    centres: np.ndarray


def fit_cells(chunks: DataFrame, k: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Cells:
    """Centres from about ``sample_rows`` chunk vectors, chosen by a hash of their id.

    Without ``k`` there are about as many cells as the root of the number of vectors.
    """
    vectors = chunks.where("vector is not null").select("chunk_id", "vector")
    total = vectors.count()
    if not total:
        return Cells(np.zeros((0, 0)))
    share = min(1.0, sample_rows / total)
    some = vectors.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    points = written(some.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")), "sample")
    k = k or min(MOST_CELLS, max(1, round(total**0.5)))
    if k == 1 or points.limit(2).count() < 2:
        first = points.first()
        return Cells(np.array([first[0].toArray()]) if first else np.zeros((0, 0)))
    model = KMeans(k=k, seed=seed, maxIter=ROUNDS, initMode="random").fit(points)
    return Cells(np.array(model.clusterCenters()))


def with_cells(chunks: DataFrame, cells: Cells) -> DataFrame:
    """Adds ``cell`` and ``cell_distance``; null without a vector of the centres' width.

    Only the vectors go through Python; a matrix product finds the centre, whose distance
    is then computed term by term.
    """
    centres = cells.centres

    @F.pandas_udf(StructType([StructField("cell", IntegerType()), StructField("cell_distance", DoubleType())]))
    def place(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": pd.array([None] * len(vectors), "Int32"), "cell_distance": np.full(len(vectors), np.nan)})
        fits = np.array([v is not None and len(centres) > 0 and len(v) == centres.shape[1] for v in vectors], bool)
        rows = np.flatnonzero(fits)
        if len(rows):
            nearest, far = np.zeros(len(rows), int), np.zeros(len(rows))
            sizes = (centres**2).sum(axis=1)
            for at in range(0, len(rows), blocks.TILE):
                held = np.stack([vectors.iloc[i] for i in rows[at:at + blocks.TILE]]).astype(np.float64)
                here = (sizes[None] - 2 * held @ centres.T).argmin(axis=1)
                nearest[at:at + blocks.TILE] = here
                far[at:at + blocks.TILE] = np.sqrt(((held - centres[here]) ** 2).sum(axis=1))
            out.loc[rows, "cell"] = nearest
            out.loc[rows, "cell_distance"] = far
        out["cell_distance"] = out["cell_distance"].where(out["cell"].notna(), None)
        return out

    placed = chunks.withColumn("_place", place(F.col("vector")))
    return placed.withColumns({
        "cell": F.col("_place.cell"),
        "cell_distance": F.when(F.col("_place.cell").isNotNull(), F.col("_place.cell_distance")),
    }).drop("_place")


def cell_table(chunks: DataFrame) -> DataFrame:
    """(scope, cell, n, low, high): the chunks of a scope by cell, with the bounds of their distances to its centre."""
    return chunks.groupBy("scope", "cell").agg(
        F.count("*").alias("n"), F.min("cell_distance").alias("low"), F.max("cell_distance").alias("high")
    )


def _path(centres: np.ndarray) -> np.ndarray:
    """Place of each centre on a path that goes on to the nearest centre left."""
    places = np.zeros(len(centres), int)
    left, at = np.ones(len(centres), bool), 0
    for n in range(len(centres)):
        places[at], left[at] = n, False
        if n + 1 < len(centres):
            far = ((centres - centres[at]) ** 2).sum(axis=1)
            at = int(np.where(left, far, np.inf).argmin())
    return places


def _in_parts(table: DataFrame, cells: Cells, size: int) -> DataFrame:
    """``cell_table`` with ``start``: the chunks of a scope lie one after the other, cells near each other together."""
    placed = [(NO_CELL, -1), *((k, int(p)) for k, p in enumerate(_path(cells.centres)))]
    order = table.sparkSession.createDataFrame(placed, "cell int, place int")
    before = Window.partitionBy("scope").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return table.join(F.broadcast(order), "cell").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.lit(size))


def _bounds(asked: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per question and cell: distance to the centre (infinite without one), and least distance of a chunk."""
    far = np.full((len(asked), len(cell)), np.inf)
    least = np.zeros(far.shape)
    for k in np.flatnonzero(cell != NO_CELL):
        far[:, k] = np.sqrt(((asked - centres[cell[k]]) ** 2).sum(axis=1))
        least[:, k] = np.maximum(np.maximum(far[:, k] - high[k], low[k] - far[:, k]), 0)
    return far, least


def _reach(limit: np.ndarray) -> np.ndarray:
    return np.sqrt(limit) * (1 + _MARGIN) + _MARGIN


def _home(far: np.ndarray, n: np.ndarray, pool: int) -> np.ndarray:
    """Per question the nearest centres whose cells hold ``pool`` chunks together (questions x cells)."""
    order = np.argsort(far, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    out = np.zeros(far.shape, bool)
    np.put_along_axis(out, order, before < pool, axis=1)
    return out & np.isfinite(far)


def visits(questions: DataFrame, table: DataFrame, cells: Cells, pool: int, of: str, block: int = VISITORS) -> DataFrame:
    """What a question is to meet, a row each, of the cells of its scope.

    questions(question_id, scope, vector, limit) and ``_in_parts``.  ``of="home"``: the cells around
    the question, (question_id, scope, vector, limit, unit, n), unit a cell.  ``of="parts"``: the
    same with the parts of the scope where a chunk may lie within the limit, the squared distance of the worst that
    still counts; as many rows at most as the scope has parts.  ``of="cells"``: (question_id, scope, cell, n)
    of those cells.  The cells of a scope meet its questions block by block.
    """
    centres = cells.centres
    counts = questions.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    left = questions.join(counts, "scope").withColumn("_q", F.pmod(F.xxhash64("question_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    right = table.join(counts, "scope").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    own = ["question_id", "scope"] if of == "cells" else ["question_id", "scope", "vector", "limit"]
    kept = questions.select(*own).schema
    schema = StructType([*kept, StructField("cell" if of == "cells" else "unit", IntegerType()), StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def choose(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return arrow.empty_table()
        cell, n, start, low, high = (held.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "start", "low", "high"))
        far, least = _bounds(blocks.matrix(asked.column("vector")), cell, low.astype(float), high.astype(float), centres)
        wanted = _home(far, n, pool)
        units, counted = cell, n
        if of != "home":
            limit = asked.column("limit").to_numpy(zero_copy_only=False).astype(float)
            wanted |= least <= _reach(limit)[:, None]
        if of == "parts":
            size = held.column("size")[0].as_py()
            units = np.arange((start + n - 1).max() // size + 1)
            covers = (start[:, None] // size <= units) & (units <= (start + n - 1)[:, None] // size)
            wanted = wanted.astype(np.float32) @ covers.astype(np.float32) > 0
            counted = np.full(len(units), size)
        rows, at = np.nonzero(wanted)
        more = [pa.array(units[at].astype(np.int32)), pa.array(counted[at].astype(np.int64))]
        return pa.table([*asked.select(own).take(pa.array(rows)).columns, *more], names=arrow.names).cast(arrow)

    pairs = left.groupBy("scope", "_q").cogroup(right.groupBy("scope", "_q"))
    return pairs.applyInArrow(choose, schema)


def _best_within(asked: pa.Table, held: pa.Table, pool: int, centres: np.ndarray, path: np.ndarray) -> blocks.Hits:
    """The ``pool`` nearest chunks for each question, of those that the bounds of their cells leave.

    Both lie in the order of cells: a tile of questions meets runs of cells that are near each other.
    """
    cell = held.column("cell").to_numpy()
    order = np.argsort(np.where(cell == NO_CELL, -1, path[cell] if len(path) else -1), kind="stable")
    chunks, ids, cell = blocks.matrix(held.column("vector"))[order], blocks.ids(held.column("chunk_id"))[order], cell[order]
    off = held.column("cell_distance").to_numpy(zero_copy_only=False).astype(float)[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[starts[1:], len(cell)]
    low, high = np.minimum.reduceat(off, starts), np.maximum.reduceat(off, starts)
    questions = blocks.matrix(asked.column("vector"))
    around = centres[cell[starts[cell[starts] != NO_CELL]]] if len(centres) else centres
    lead = np.zeros(len(questions), int)
    for at in range(0, len(questions) if len(around) else 0, blocks.TILE):
        lead[at:at + blocks.TILE] = ((around**2).sum(axis=1) - 2 * questions[at:at + blocks.TILE] @ around.T).argmin(axis=1)
    by_lead = np.argsort(lead, kind="stable")
    questions = questions[by_lead]
    limits = asked.column("limit").to_numpy(zero_copy_only=False).astype(float)[by_lead]
    limits = np.where(np.isnan(limits), np.inf, limits)
    # Runs of whole cells; a large cell is cut further below.
    runs = np.flatnonzero(np.r_[True, np.diff(starts // (blocks.TILE * 4)) > 0])
    out: list[blocks.Hits] = []
    for at in range(0, len(questions), blocks.TILE):
        q, r = questions[at:at + blocks.TILE], limits[at:at + blocks.TILE]
        tile = blocks.Best(q, r, pool)
        _, least = _bounds(q, cell[starts], low, high, centres)
        for first, last in zip(runs, np.r_[runs[1:], len(starts)]):
            needed = least[:, first:last] <= _reach(tile.worst)[:, None]
            rows = np.flatnonzero(needed.any(axis=1))
            if not len(rows):
                continue
            some = [np.arange(starts[first + k], ends[first + k]) for k in np.flatnonzero(needed.any(axis=0))]
            met = np.concatenate(some)
            for lo in range(0, len(met), blocks.TILE * 4):
                here = met[lo:lo + blocks.TILE * 4]
                tile.meet(chunks[here], ids[here], rows)
        if tile.hits is not None:
            out.append((by_lead[tile.hits[0] + at], *tile.hits[1:]))
    return blocks.join(out) if out else (np.array([], int), ids[:0], np.array([]))


def compare(met: DataFrame, chunks: DataFrame, pool: int, cells: Cells, schema: StructType, block_questions: int, block_chunks: int) -> DataFrame:
    """The ``pool`` best of each unit (a cell or a part) for each question that meets it.

    Chunks of units that nobody meets go no further than this join; a large unit, or one
    that many questions meet, is cut into blocks.
    """
    arrow = to_arrow_schema(schema)
    centres, path = cells.centres, _path(cells.centres)
    sizes = met.groupBy("scope", "unit").agg(
        F.ceil(F.max("n") / block_chunks).cast("int").alias("_cb"), F.ceil(F.count("*") / block_questions).cast("int").alias("_qb")
    )

    def place(df: DataFrame, key: str, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        return (
            df.join(sizes, ["scope", "unit"])
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_blocks)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))
            .drop("_cb", "_qb")
        )

    left = place(met.drop("n"), "question_id", "_q", "_qb", "_c", "_cb")
    right = place(chunks, "chunk_id", "_c", "_cb", "_q", "_qb")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return arrow.empty_table()
        return blocks.table(blocks.ids(asked.column("question_id")), _best_within(asked, held, pool, centres, path), arrow)

    groups = ("scope", "unit", "_q", "_c")
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(search, schema)


def search_by_cells(
    questions: DataFrame, chunks: DataFrame, pool: int, cells: Cells,
    block_questions: int = R.BLOCK_QUESTIONS, block_chunks: int = R.BLOCK_CHUNKS,
) -> tuple[DataFrame, DataFrame]:
    """(hits, met): the rows of ``retrieval.nearest``, and (question_id, scope, cell, n) of the cells that the bounds leave.

    ``chunks`` as for ``nearest`` with ``cell`` and ``cell_distance``.  The cells around a question bound its
    pool; then its vector goes to the parts of its scope that may hold something nearer, at most
    as many as there are blocks of chunks, and there meets the cells that the bounds
    leave.  Chunks without a cell are met by every question of their scope.  ``met`` is
    computed when it is read.
    """
    schema = R._hit_schema(questions, chunks)
    asked = written(questions.where("scope is not null and vector is not null").select("question_id", "scope", "vector"), "asked")
    held = chunks.where("scope is not null and vector is not null").select(
        "chunk_id", "scope", "vector", F.coalesce("cell", F.lit(NO_CELL)).alias("cell"), "cell_distance"
    )
    table = written(_in_parts(cell_table(held), cells, block_chunks), "cells")
    home = written(visits(asked.withColumn("limit", F.lit(None).cast("double")), table, cells, pool, "home"), "home")
    by_cell = compare(home, held.withColumn("unit", F.col("cell")), pool, cells, schema, block_questions, block_chunks)
    found = R.top(by_cell, pool, "distance", "chunk_id")
    # Fewer than the pool: all that there is may still count.
    worst = found.groupBy("question_id").agg(F.max(F.when(F.col("rank") == pool, F.col("distance"))).alias("limit"))
    bounded = written(asked.join(worst, "question_id", "left").withColumn("limit", F.coalesce("limit", F.lit(1e300))), "bounded")
    position = F.col("start") + F.pmod(F.xxhash64("chunk_id"), F.col("n"))
    in_parts = held.join(table.select("scope", "cell", "start", "n"), ["scope", "cell"]).withColumn(
        "unit", F.floor(position / block_chunks).cast("int")
    ).drop("start", "n")
    parts = written(visits(bounded, table, cells, pool, "parts"), "parts")
    hits = R.top(compare(parts, in_parts, pool, cells, schema, block_questions, block_chunks), pool, "distance", "chunk_id")
    return hits, visits(bounded, table, cells, pool, "cells")


def nearest_by_cells(questions: DataFrame, chunks: DataFrame, pool: int, cells: Cells, **blocks: int) -> DataFrame:
    return search_by_cells(questions, chunks, pool, cells, **blocks)[0]


def finder(cells: Cells, **blocks: int) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """The search as the ``find`` of ``retrieval.hybrid_search`` and what builds on it."""
    return partial(nearest_by_cells, cells=cells, **blocks)
