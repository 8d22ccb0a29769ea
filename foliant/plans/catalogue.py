"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

from . import extension_queries, layout_queries, relational_queries, round_trip_queries, scan_queries, sidecar_queries, signal_queries, spatial_queries, stream_queries, table_queries, text_queries, token_queries, verify_queries  # noqa: F401
from .base import QUERIES, SQL

FLAGSHIP = "micro_accuracy_by_role"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
