"""Registered queries: each operator applied to the given tables, with the same question
in plain SQL where SQL can ask it."""

from registry.core import REGISTRY, oracles, runners
from registry import (  # noqa: F401  (importing registers the queries)
    aggregates, boards, changes, filters, forecasts, joins, pages, rollups, scalars, scans, streams, windows)

__all__ = ["REGISTRY", "oracles", "runners"]
