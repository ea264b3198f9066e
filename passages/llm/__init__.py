"""Training-data operators. Nothing outside this subpackage imports it."""

from passages.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
