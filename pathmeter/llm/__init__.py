"""Operators that prepare training text; nothing else in the library imports this."""

from pathmeter.llm.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
