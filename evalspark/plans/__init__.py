"""Registered queries (``queries.QUERIES``) and their DuckDB oracle SQL (``oracle.ORACLE``)."""
