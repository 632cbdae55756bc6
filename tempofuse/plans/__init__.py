"""Queries of the library by name, and their SQL."""

from tempofuse.plans import alignment, chain_queries, export_queries, format_queries, fusion_queries, geometry_queries, motion_queries, quality_queries, scan_queries, streaming_queries  # noqa: F401
from tempofuse.plans.base import QUERIES, SQL  # noqa: F401
