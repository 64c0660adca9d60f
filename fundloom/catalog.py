"""All queries of the engine by name, and their SQL."""

from .operators import aggregates, documents, extras, finance, fundframe, keys, ladders, metrics, names, portfolio, records, register, report, reporting, reshape, relational, routing, scalars, sheets, sinks, trees, workbooks  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
