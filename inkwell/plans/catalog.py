"""All registered queries."""

from __future__ import annotations

from . import catalog_queries, flow_queries, index_queries, layout_queries, more_queries, order_queries, parse_queries, record_queries, report_queries, selection_queries, source_queries, span_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
