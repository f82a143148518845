"""The queries over the given tables, by name, and their SQL."""

from __future__ import annotations

from docweir.plans import more_queries, run_queries  # noqa: F401  register further queries
from docweir.plans.queries import ORACLES, QUERIES

FLAGSHIP = "hybrid_fuse"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
