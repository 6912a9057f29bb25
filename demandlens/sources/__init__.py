"""Readers, writers and the stand-in views over the driver tables."""

from demandlens.sources.tables import TABLES, mentions, mentions_sql, table

__all__ = ["TABLES", "mentions", "mentions_sql", "table"]
