"""Distances and the embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, for pairs that are already few."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda total, d: total + d)


def embedder(load: Callable[[], Callable[[Sequence[str]], np.ndarray]], batch: int = 256):
    """A column function that embeds text with a model of the caller's choice.

    ``load`` runs once per Python worker and returns ``texts -> matrix``; the same
    function must be used for chunks and for questions.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            filled = texts.fillna("")
            rows: list[np.ndarray] = []
            for at in range(0, len(filled), batch):
                rows.extend(np.asarray(model(filled.iloc[at:at + batch].tolist()), dtype=np.float32))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return embed
