"""Registered queries: every operator on the shared tables, each with its SQL counterpart."""

from millrace.workload import (  # noqa: F401  (importing a module registers its queries)
    incremental,
    joins,
    lineage,
    metadata,
    models,
    quality,
    sources,
    streams,
    tasks,
    totals,
)
from millrace.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
