"""Blocks of vectors compared in a task: NumPy on Arrow, memory bounded by tiles.

Apart from the DataFrame code, so that what travels with a query are these functions alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TILE = 1_024
_PAIR_CELLS = 4_000_000  # vector cells of the pairs whose distances are computed at once
_MARGIN = 1e-9  # for the rounding of the first cut, relative

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # question row, chunk id, distance


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; all must have the width of the first and no null cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if len(widths) and (flat.null_count or (widths != widths[0]).any()):
        raise ValueError("vectors of different widths or with null cells cannot be compared")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def cut(hits: Hits, pool: int) -> Hits:
    """The first ``pool`` of each question by distance, then chunk id."""
    rows, ids, distances = hits
    order = np.lexsort((ids, distances, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    order, rows = order[place < pool], rows[place < pool]
    return rows, ids[order], distances[order]


def join(parts: list[Hits]) -> Hits:
    return tuple(np.concatenate(c) for c in zip(*parts))


class Best:
    """The ``pool`` nearest of the chunks met so far, for a tile of questions.

    A matrix product gives a first cut with a margin for its rounding, by the worst that
    still counts; the distances of what is left are computed term by term.  ``limits`` are squared
    distances beyond which nothing counts, infinite where none is known.
    """

    def __init__(self, questions: np.ndarray, limits: np.ndarray, pool: int):
        self.questions, self.pool = questions, pool
        self.sizes = np.einsum("ij,ij->i", questions, questions)
        self.worst = limits.copy()
        self.hits: Hits | None = None

    def meet(self, chunks: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Compares the questions, or those in the rows ``asked``, with at most some thousand chunks."""
        if not len(chunks):
            return
        asked = np.arange(len(self.questions)) if asked is None else asked
        q, sizes = self.questions[asked], self.sizes[asked]
        norms = np.einsum("ij,ij->i", chunks, chunks)
        near = (q * -2.0) @ chunks.T
        near += norms
        margin = _MARGIN * (1.0 + norms.max() + sizes)
        limit = self.worst[asked] - sizes + margin
        if len(chunks) > self.pool and (self.hits is None or np.isinf(limit).any()):
            limit = np.minimum(limit, np.partition(near, self.pool - 1, axis=1)[:, self.pool - 1] + margin)
        rows, columns = np.divmod(np.flatnonzero(near <= limit[:, None]), len(chunks))
        if len(rows) > 4 * self.pool * len(asked) and len(chunks) > self.pool:
            limit = np.minimum(limit, np.partition(near, self.pool - 1, axis=1)[:, self.pool - 1] + margin)
            rows, columns = np.divmod(np.flatnonzero(near <= limit[:, None]), len(chunks))
        step = max(1, _PAIR_CELLS // max(1, chunks.shape[1]))
        found = [self.hits] if self.hits is not None else []
        for some in range(0, len(rows), step):
            r, c = rows[some:some + step], columns[some:some + step]
            found.append(cut((asked[r], ids[c], ((chunks[c] - q[r]) ** 2).sum(axis=1)), self.pool))
        if not len(rows):
            return
        self.hits = cut(join(found), self.pool)
        held = np.bincount(self.hits[0], minlength=len(self.worst))
        full = np.flatnonzero(held == self.pool)
        self.worst[full] = np.minimum(self.worst[full], self.hits[2][np.cumsum(held)[full] - 1])


def best(questions: np.ndarray, ids: np.ndarray, chunks: np.ndarray, pool: int) -> Hits:
    """The ``pool`` nearest of some chunks for each question.

    Work goes by tiles, so memory does not follow the number of questions or of equal distances.
    """
    out: list[Hits] = []
    for at in range(0, len(questions), TILE):
        block = questions[at:at + TILE]
        tile = Best(block, np.full(len(block), np.inf), pool)
        for lo in range(0, len(chunks), TILE * 4):
            tile.meet(chunks[lo:lo + TILE * 4], ids[lo:lo + TILE * 4])
        if tile.hits is not None:
            out.append((tile.hits[0] + at, *tile.hits[1:]))
    return join(out) if out else (np.array([], int), ids[:0], np.array([]))


def places(column: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    """Row numbers per value, by one sort."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    return {v: order[lo:hi] for v, lo, hi in zip(coded.dictionary.to_pylist(), bounds, bounds[1:])}


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    out = np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())
    return out.astype(str) if out.dtype == object else out


def table(question_ids: np.ndarray, hits: Hits | None, schema: pa.Schema) -> pa.Table:
    if hits is None:
        return schema.empty_table()
    columns = (question_ids[hits[0]], hits[1], hits[2])
    return pa.table(
        [pa.array(c.tolist() if c.dtype.kind == "U" else c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
