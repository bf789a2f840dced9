"""Lineage of SQL statements: a typed graph of tables, queries, columns and expressions."""

from .dot import to_dot
from .endpoints import Endpoints, endpoints, endpoints_of_files, schema_hints
from .graph import Graph, lineage

__all__ = ["Endpoints", "Graph", "endpoints", "endpoints_of_files", "lineage", "schema_hints", "to_dot"]
