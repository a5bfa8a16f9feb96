"""Every named query over the test tables, with the SQL that it must agree with."""

from __future__ import annotations

from veilframe.plans import element_queries, raster_queries, table_queries, text_queries
from veilframe.plans.registry import ORACLES, QUERIES

FLAGSHIP = "deid_flagship"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "element_queries", "raster_queries", "table_queries", "text_queries"]
