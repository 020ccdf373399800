"""The queries of the library itself, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from covalens.plans import locus_queries, panel_queries, record_queries, source_queries
from covalens.plans.queries import ORACLES, QUERIES

FLAGSHIP = "interval_coverage"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "locus_queries", "panel_queries", "record_queries", "source_queries"]
