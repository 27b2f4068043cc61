"""Every query of the library with the SQL that checks it."""

from __future__ import annotations

from docloom.plans import annot_queries, edit_queries, file_queries, flow_queries, form_queries, layout_queries, page_queries, search_queries, style_queries, table_queries, text_queries  # noqa: F401  (they register)
from docloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
