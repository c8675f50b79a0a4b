"""All registered training-data queries."""

from clauseflow.llm import (  # noqa: F401
    chat,
    decontaminate,
    licenses,
    line_dedup,
    middle,
    mixing,
    ngram_join,
    passage_dedup,
    personal,
    quality,
    sharding,
    toxicity,
    vector_codes,
)
from clauseflow.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
