"""All queries of the engine and their SQL."""

from __future__ import annotations

from rowloom.plans import q_aggregate, q_growth, q_join, q_more, q_peaks, q_raster, q_rules, q_scalar, q_sequence, q_stream  # noqa: F401, I001
from rowloom.plans.catalog import ORACLE_SQL, QUERIES

FLAGSHIP = "row_failures"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
