"""All queries by name, and their SQL."""

from __future__ import annotations

from . import context_queries, cross_record, pipeline_queries, reference_joins, report_queries, source_queries, stateless, statistics, stream_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
