"""Vector code compression (12): product codes, trained and assigned over Hilbert-sorted blocks.

Vectors become integers and are cut into equal parts.  The parts of one position are sorted
along a Hilbert curve and laid into flat blocks that carry their box (least and greatest
components) and their sums.  In each round the distances of a box to the codebook's
entries leave a shortlist: an entry whose nearest corner is farther than another's farthest
one cannot win.  A block with one entry left is decided by its sums alone; the others by a
small exact integer kernel over the shortlist.  No vector is shuffled: a round sends the
entries to every task and brings back their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import query, remove, saved, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24  # components beyond it are taken for it, so that no sum of squares overflows
BLOCK = 64  # parts of a block
KEY_BITS = 62
_CELLS = 1 << 18  # differences a kernel or a box test holds at once, about


# ------------------------------------------------------------------ curve
def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of cells (rows of ``bits``-bit numbers), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            swapped = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(x[i] & q, q - 1, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turned ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turned
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> b & 1
    return place


def curve_order(points: np.ndarray) -> np.ndarray:
    """Row numbers along the curve through the points' own box; very wide points go by their first components."""
    points = points[:, :KEY_BITS]
    if not points.size:
        return np.arange(len(points))
    bits = min(10, KEY_BITS // points.shape[1])
    low = points.min(axis=0)
    extent = np.maximum(points.max(axis=0) - low, 1)
    return np.argsort(hilbert((points - low) * ((1 << bits) - 1) // extent, bits), kind="stable")


# ----------------------------------------------------------------- blocks
class Blocks:
    """Boxes and sums of consecutive stretches of sorted points."""

    def __init__(self, points: np.ndarray, size: int = BLOCK):
        self.points = points
        self.starts = np.arange(0, len(points), size)
        self.counts = np.diff(np.append(self.starts, len(points)))
        self.low, self.high, self.sums = (f.reduceat(points, self.starts, axis=0) for f in (np.minimum, np.maximum, np.add))

    def of(self, k: int) -> np.ndarray:
        return self.points[self.starts[k] : self.starts[k] + self.counts[k]]


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box the entries that may be nearest to one of its points (boxes x entries).

    Of equal entries only the first can win, as ties go to the lower index.
    """
    out = np.zeros((len(low), len(entries)), bool)
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    held = entries[first][None]
    step = max(1, _CELLS // max(1, held.size))
    for at in range(0, len(low), step):
        lo, hi = low[at : at + step, None], high[at : at + step, None]
        near = (np.maximum(np.maximum(lo - held, held - hi), 0) ** 2).sum(axis=2)
        far = (np.maximum(np.abs(held - lo), np.abs(held - hi)) ** 2).sum(axis=2)
        out[at : at + step, first] = near <= far.min(axis=1, keepdims=True)
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index; exact integers."""
    at, least = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    step = max(1, _CELLS // max(1, entries.size))
    for k in range(0, len(points), step):
        distances = ((points[k : k + step, None] - entries[None]) ** 2).sum(axis=2)
        at[k : k + step] = distances.argmin(axis=1)
        least[k : k + step] = distances.min(axis=1)
    return at, least


def assign(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for many points, by way of their sorted blocks."""
    index, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    if not len(points):
        return index, error
    order = curve_order(points)
    blocks = Blocks(points[order])
    for k, listed in enumerate(shortlists(blocks.low, blocks.high, entries)):
        rows = order[blocks.starts[k] : blocks.starts[k] + blocks.counts[k]]
        listed = np.flatnonzero(listed)
        at, error[rows] = nearest(blocks.of(k), entries[listed])
        index[rows] = listed[at]
    return index, error


def parts_of(column: pa.Array, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that width, their integers as rows x parts x components); a width that the
    parts do not divide is filled up with zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    fits = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(fits), width)
    out = np.zeros((len(fits), parts, -(-width // parts)), np.int64)
    out.reshape(len(fits), -1)[:, :width] = whole
    return fits, out


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.int64()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _layer(width: int, parts: int):
    """Vectors into flat blocks, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, whole = parts_of(batch.column("vector"), width, parts)
            for part in range(parts if len(whole) else 0):
                points = whole[:, part]
                blocks = Blocks(points[curve_order(points)])
                held = [blocks.of(k).astype(np.int32).tobytes() for k in range(len(blocks.starts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), part), pa.int32()), pa.array(blocks.counts, pa.int64()),
                        *map(_lists, (blocks.low, blocks.high, blocks.sums)), pa.array(held, pa.binary()),
                    ],
                    ["part", "n", "low", "high", "sums", "points"],
                )

    return rows


def _summer(codebooks: np.ndarray):
    """Per task and entry: how many parts it is nearest to, and their sums."""
    parts, entries, width = codebooks.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            low, high, total = (_matrix(batch.column(c)) for c in ("low", "high", "sums"))
            n, points = batch.column("n").to_numpy(), batch.column("points")
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                listed = shortlists(low[here], high[here], codebooks[p])
                alone = listed.sum(axis=1) == 1
                winner = listed[alone].argmax(axis=1)
                np.add.at(counts[p], winner, n[here[alone]])
                np.add.at(sums[p], winner, total[here[alone]])
                for k in np.flatnonzero(~alone):
                    some = np.flatnonzero(listed[k])
                    held = np.frombuffer(points[here[k]].as_py(), np.int32).reshape(-1, width).astype(np.int64)
                    at, _ = nearest(held, codebooks[p][some])
                    np.add.at(counts[p], some[at], 1)
                    np.add.at(sums[p], some[at], held)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
                pa.array(np.repeat(counts[p, e], width)), pa.array(sums[p, e].ravel()),
            ],
            ["part", "entry", "place", "n", "total"],
        )

    return rows


def _coder(codebooks: np.ndarray, vector_width: int):
    parts = len(codebooks)
    digits = np.array([f"{k:02x}" for k in range(codebooks.shape[1])])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, whole = parts_of(batch.column("vector"), vector_width, parts)
            codes: list[str | None] = [None] * batch.num_rows
            error = np.zeros(batch.num_rows, np.int64)
            letters = np.empty((len(fits), parts), digits.dtype)
            for part in range(parts):
                at, off = assign(whole[:, part], codebooks[part])
                letters[:, part] = digits[at]
                error[fits] += off
            for row, text in zip(fits.tolist(), letters.tolist()):
                codes[row] = "".join(text)
            none = np.ones(batch.num_rows, bool)
            none[fits] = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, mask=none)],
                ["vec", "label", "code", "error"],
            )

    return rows


# -------------------------------------------------------------- operator
def usable(vector: str | Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray]:
    """(width, codebooks) from the vectors of the smallest ids; at most ``entries`` reach the driver."""
    order = (F.col("vec").asc_nulls_last(), F.col("vector"))
    start = kept.orderBy(*order).limit(1).select(F.size("vector")).first()
    if start is None:
        return 0, np.zeros((parts, 0, 0), np.int64)
    rows = kept.where(F.size("vector") == start[0]).orderBy(*order).limit(entries).select("vector").toArrow()
    _, whole = parts_of(rows.column("vector").combine_chunks(), start[0], parts)
    return start[0], whole.transpose(1, 0, 2).copy()


def trained(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Entries moved ``rounds`` times to the floored mean of their parts; unused ones stay."""
    for _ in range(rounds):
        sums = blocks.mapInArrow(_summer(codebooks), "part int, entry int, place int, n long, total long")
        totals = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        codebooks = codebooks.copy()
        for row in totals.collect():  # one number for each component of the codebooks at most
            codebooks[row["part"], row["entry"], row["place"]] = row["total"] // row["n"]
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """The coded vectors (id, label, ``code``, ``error``), as a written table, and the codebooks
    (parts x entries x components).

    Vectors that are null or hold a null or non-finite component are left out.  The width is
    that of the smallest kept id (equal ids: of the smallest vector; null ids come last); a
    vector of another width stays, with a null code and error, and teaches nothing.  A width
    that the parts do not divide is filled up with zeros.  With fewer vectors than entries there are as many
    entries as vectors.  Repeated rows repeat and count each; at most 256 entries.  Components
    beyond 65,536 count as that.  Ids and labels may be of any type; other columns are not
    read.  No rows give no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    kept = vectors.select(
        F.col(id_col).alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    ).where(usable("vector"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    width, codebooks = first_codebooks(kept, parts, entries)
    if codebooks.size:
        blocks, path = saved(kept.select("vector").mapInArrow(
            _layer(width, parts),
            "part int, n long, low array<long>, high array<long>, sums array<long>, points binary",
        ), "blocks")
        codebooks = trained(blocks, codebooks, rounds)
        remove(spark, path)
    coded = kept.mapInArrow(
        _coder(codebooks, width), f"vec {types['vec']}, label {types['label']}, code string, error long"
    )
    out, _ = saved(coded, "codes")
    return out.select(F.col("vec").alias(id_col), F.col("label").alias(label_col), "code", "error"), codebooks


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``: the error of all vectors of a label, null being one.

    The sums are written first, so their size is known: few labels are sent to the rows by
    Spark's own limit, many meet them by a join that Spark may split.
    """
    sums = codes.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    sums, _ = saved(sums, "label_errors")
    return codes.join(sums, F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")


def _sql() -> str:
    square = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT"

    def assigned(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
    SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v
    FROM (SELECT x.vec_id, x.part, x.v, b.entry, {square} AS d FROM pieces x JOIN book{k} b USING (part))
    GROUP BY vec_id, part
)"""

    def moved(k: int) -> str:
        return f"""book{k + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY place) AS v FROM (
            SELECT part, entry, place, floor(sum(v[place])::DOUBLE / count(*))::BIGINT AS mean
            FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM pieces) + 1)) AS place)
            GROUP BY part, entry, place
        ) GROUP BY part, entry
    ) m USING (part, entry)
)"""

    steps = [s for k in range(ROUNDS) for s in (assigned(k), moved(k))]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS whole FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
    SELECT vec_id, part, whole[part * (len(whole) // {PARTS}) + 1:(part + 1) * (len(whole) // {PARTS})] AS v
    FROM kept, (SELECT unnest(range({PARTS})) AS part)
), book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
    FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})
), {", ".join(steps)}, {assigned(ROUNDS)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM near{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query(_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = vector_codes(table(spark, sf_dir, "embeddings"))
    out = label_errors(codes).withColumn("codebooks_sha256", F.lit(digest(codebooks)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
