"""All registered queries."""

from clauseflow.plans import (  # noqa: F401
    ingest_checks,
    retrieval_checks,
    run_checks,
    selection_checks,
    stream_checks,
    text_checks,
)
from clauseflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
