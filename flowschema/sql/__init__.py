"""SQL front end: two dialects to one tree, and the tree to text, Spark SQL or lineage."""

from .parser import SqlError, parse, parse_one
from .printer import to_sql

__all__ = ["SqlError", "parse", "parse_one", "to_sql"]
