"""All queries on the reference's own operators."""

from __future__ import annotations

from terradelta.plans import io_queries, metric_queries, raster_queries, spatial_queries, table_queries  # noqa: F401
from terradelta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
