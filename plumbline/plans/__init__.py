"""Registered queries: each operator run over the test tables, with its SQL counterpart."""

from plumbline.plans.registry import ORACLES, QUERIES

# importing the families fills the registry
from plumbline.plans import (  # noqa: E402,F401
    charting,
    cleaning,
    drifting,
    featuring,
    ingesting,
    learning,
    profiling,
    reporting,
    screening,
    selecting,
    statistics,
)

__all__ = ["ORACLES", "QUERIES"]
