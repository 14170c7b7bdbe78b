"""Registered queries (one per operator) and the SQL each must agree with."""

from pageloom.catalog import flow, more_sql, page_regions, pages, streams, term_store, urls_and_text  # noqa: F401
from pageloom.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
