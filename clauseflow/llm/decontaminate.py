"""Benchmark decontamination (4): q-gram lemma filtering and banded alignment.

Passages are cut into overlapping windows of ``WINDOW`` bytes with a budget of edits.  By the
q-gram lemma a region within e edits of a window of m bytes shares at least
m + 1 - q(e + 1) q-grams with it, all on diagonals at most e apart.  Q-gram hits of a text are
counted in bands of diagonals, neighbours taken together so that every such region lies in
one pair; bands that reach the bound are aligned in a band of diagonals.

Texts are compared with A-Z in lower case and runs of the six ASCII spaces as one space; edits
are counted in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm.base import given_back, query, saved, table, text_key
from clauseflow.llm.shingles import SPACES

Q = 8
WINDOW = 120
STEP = 60
EDITS = 0.1  # of a window's bytes
BLOCK_BYTES = 4 << 20  # of passages that are searched for at once
SLICE_BYTES = 1 << 19
ALIGNED_AT_ONCE = 2_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[list(SPACES)] = 32
_LOWER[0] = 1  # 0 separates texts


def normal(data: np.ndarray) -> np.ndarray:
    """Lower case, runs of spaces as one, none at the ends."""
    low = _LOWER[data]
    space = low == 32
    low = low[~(space & np.append(True, space[:-1]))] if len(low) else low
    return low[:-1] if len(low) and low[-1] == 32 else low


def budget(length: int) -> int:
    """Edits allowed in a window: the share, as far as the bound stays at one q-gram or more."""
    return max(0, min(int(length * EDITS), length // Q - 1))


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


class Passages:
    """The windows of some passages and where their q-grams stand."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        self.windows: list[tuple[int, bytes]] = []
        for item, text in passages:
            flat = normal(np.frombuffer(text, np.uint8)).tobytes()
            last = max(0, len(flat) - WINDOW)
            starts = [*range(0, last, STEP), last]
            self.windows += [(item, flat[s : s + WINDOW]) for s in starts if len(flat) >= Q]
        length = np.array([len(w) for _, w in self.windows], np.int64)
        self.edits = np.array([budget(n) for n in length.tolist()], np.int64)
        self.bound = length + 1 - Q * (self.edits + 1)
        data = [grams(np.frombuffer(w, np.uint8)) for _, w in self.windows]
        flat = np.concatenate([*data, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.window = np.repeat(np.arange(len(data)), [len(g) for g in data])[order]
        self.offset = np.concatenate([*(np.arange(len(g)) for g in data), np.empty(0, np.int64)])[order].astype(np.int64)
        self.gram, self.first = np.unique(flat[order], return_index=True)
        self.held = np.diff(np.append(self.first, len(flat)))
        self.shift = np.uint64(64 - max(16, int(len(self.gram) * 32).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self._slot(self.gram)] = True

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def regions(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, lowest start, highest start) of the bands of a text that reach the bound."""
        if not len(self.gram):
            return []
        own = grams(data)
        at = np.flatnonzero(self.seen[self._slot(own)])
        # A region needs its bound of hits within a window's length and budget.
        near = int(self.bound.min())
        reach = WINDOW + int(self.edits.max())
        if len(at) < near:
            return []
        dense = at[near - 1 :] - at[: len(at) - near + 1] <= reach
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(dense), 1)
        np.add.at(mark, np.flatnonzero(dense) + near, -1)
        at = at[np.cumsum(mark[:-1]) > 0]
        found = np.minimum(np.searchsorted(self.gram, own[at]), len(self.gram) - 1)
        real = self.gram[found] == own[at]
        at, found = at[real], found[real]
        many = self.held[found]
        place = np.repeat(self.first[found] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        window = self.window[place]
        start = np.repeat(at, many) - self.offset[place]
        width = self.edits[window] + 1
        band = (start + WINDOW) // width  # of at least 0
        key, count = np.unique((window << 40) | band, return_counts=True)
        after = np.append(np.where(key[1:] == key[:-1] + 1, count[1:], 0), 0) if len(key) else count
        good = count + after >= self.bound[key >> 40]
        out = []
        for k in key[good].tolist():
            w, b = k >> 40, k & ((1 << 40) - 1)
            wide = int(self.edits[w]) + 1
            out.append((w, b * wide - WINDOW, (b + 2) * wide - WINDOW))
        return out

    def verified(self, data: np.ndarray, starts: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(text, window, distance) of the bands that align within their budget.

        Bands of windows of one length are aligned together.  A band that lies over the
        end of a text is tried in each text that it touches.
        """
        jobs: dict[int, list[tuple[int, int, int]]] = {}
        for window, low, high in found:
            first = max(0, int(np.searchsorted(starts, max(0, low), "right")) - 1)
            last = min(len(starts) - 2, int(np.searchsorted(starts, max(0, high), "right")) - 1)
            for text in range(first, last + 1):
                jobs.setdefault(len(self.windows[window][1]), []).append((text, window, low))
        out = []
        for length, group in jobs.items():
            edits = budget(length)
            width = 4 * edits + 3  # two steps of the band, and the budget on either side
            for at in range(0, len(group), ALIGNED_AT_ONCE):
                part = group[at : at + ALIGNED_AT_ONCE]
                text, window, low = (np.array(c) for c in zip(*part))
                place = (low - edits)[:, None] + np.arange(width + length)
                inside = (place >= starts[text][:, None]) & (place < starts[text + 1][:, None] - 1)
                letters = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)
                patterns = np.frombuffer(b"".join(self.windows[w][1] for w in window), np.uint8).reshape(-1, length)
                best = banded(patterns, letters, edits)
                out += [(t, w, int(d)) for (t, w, _), d in zip(part, best) if d <= edits]
        return out


def banded(patterns: np.ndarray, letters: np.ndarray, edits: int) -> np.ndarray:
    """Edit distance of each pattern to the best stretch of its letters, along a band of diagonals.

    A stretch may begin at any letter of the band's width, which is what the letters are
    longer than the pattern; 0 stands for no letter.  Distances above ``edits`` are only
    known to be above.
    """
    n, length = patterns.shape
    width = letters.shape[1] - length
    place = np.arange(width, dtype=np.int16)
    far = np.int16(length + width + 1)
    row = np.zeros((n, width), np.int16)
    for i in range(length):
        taken = letters[:, i : i + width]
        step = np.where(taken == 0, far, row + (taken != patterns[:, i : i + 1]))
        drop = np.full_like(row, far)
        drop[:, :-1] = row[:, 1:] + 1  # the pattern's letter has no partner
        row = np.minimum.accumulate(np.minimum(step, drop) - place, axis=1) + place  # letters without a partner
        if row.min() > edits:
            break
    return row.min(axis=1)


def _finder(passages):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Passages(passages.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for owners, starts, data in _slices(texts):
                for text, window, found in index.verified(data, starts, index.regions(data)):
                    pair = owners[text], index.windows[window][0]
                    old = best.get(pair, (found, 0))
                    best[pair] = min(old[0], found), old[1] + 1
            hits = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array([k for (k, _), _ in hits], pa.int64())),
                    batch.column("ref").take(pa.array([k for (k, _), _ in hits], pa.int64())),
                    pa.array([i for (_, i), _ in hits], pa.int64()),
                    pa.array([v[0] for _, v in hits], pa.int32()),
                    pa.array([v[1] for _, v in hits], pa.int32()),
                ],
                ["doc", "ref", "number", "distance", "regions"],
            )

    return rows


def _slices(texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, starts, bytes) of normalised texts, each ended by a 0.

    A text that is longer than a slice comes in pieces that overlap by more than a region.
    """
    owners: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    over = 4 * WINDOW

    def slice_() -> tuple[list[int], np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        data = np.zeros(int(starts[-1]), np.uint8)
        for s, p in zip(starts, parts):
            data[s : s + len(p)] = p
        return owners, starts, data

    for k, text in enumerate(texts):
        flat = normal(np.frombuffer(text or b"", np.uint8))
        for at in range(0, max(1, len(flat) - over), SLICE_BYTES):
            piece = flat[at : at + SLICE_BYTES + over]
            if size + len(piece) > 2 * SLICE_BYTES or (owners and owners[-1] == k):
                yield slice_()
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield slice_()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", passage_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` and benchmark item of which it holds a window.

    Columns: the id, ``text_ref``, ``item_id``, ``distance`` (fewest edits of a window) and
    ``regions`` (how many were verified).  Items shorter than ``Q`` bytes say too little and
    match nothing; null or empty texts on either side match nothing; a null item is an item, whose
    id is null; rows with one id and text count as one.  Ids may be of any type; other columns
    are not read.  The benchmark is a stated query set: it is cut into blocks of about
    ``BLOCK_BYTES``, each of which meets all texts and is gone before the next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("ref", text_key("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    passages = benchmark.select(F.col(item_col).alias("item"), F.col(passage_col).cast("binary").alias("passage"))
    passages = passages.where("passage is not null").distinct().withColumn("number", F.xxhash64("item", "passage"))
    passages, _ = saved(passages, "passages")
    total = passages.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()[0]
    blocks = 1 + 2 * total // BLOCK_BYTES
    schema = f"doc {id_type}, ref string, number long, distance int, regions int"
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        block = [tuple(r) for r in passages.where(F.pmod("number", F.lit(blocks)) == k).select("number", "passage").collect()]
        shared = spark.sparkContext.broadcast([(n, bytes(p)) for n, p in block])
        hits = rows.mapInArrow(given_back(_finder(shared)), schema)
        if blocks > 1:  # a block's hits are written before the next one is read
            hits, _ = saved(hits, "hits")
            shared.unpersist()
        found = found.union(hits)
    best = found.join(passages.select("number", "item"), "number").groupBy("doc", "ref", "item").agg(
        F.min("distance").alias("distance"), F.sum("regions").alias("regions")
    )
    return best.select(F.col("doc").alias(id_col), F.col("ref").alias("text_ref"), F.col("item").alias(item_col), "distance", "regions")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose text holds no window of a benchmark item, null items included.

    Texts decide, not ids: equal texts, repeated rows and rows without an id go or stay together;
    null and empty texts stay.  All columns stay, whatever their names; no rows give no rows.
    """
    found, _ = saved(leaks(docs, benchmark, id_col, text_col).select(F.col("text_ref").alias("_leak")).distinct(), "leaks")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text_key(text_col).alias("_of"))
    return whole.join(found, F.col("_of") == F.col("_leak"), "left_anti").select("_row.*")


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", F.col("regions").cast("long").alias("regions"))
