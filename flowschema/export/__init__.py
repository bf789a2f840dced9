"""The table model in other schema languages."""

from .code import to_dataclass, to_scala
from .ddl import ansi_ddl, clickhouse_ddl, spark_ddl
from .text import to_beam, to_dbml

__all__ = ["ansi_ddl", "clickhouse_ddl", "spark_ddl", "to_beam", "to_dataclass", "to_dbml", "to_scala"]
