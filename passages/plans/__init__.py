"""Queries: operators applied to the driver's tables, each with the SQL that it must equal where SQL can express it."""
