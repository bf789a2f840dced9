"""Tables of a folder as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, folder: str, tables: list[str] | None = None) -> None:
    """Make folder/<table>.parquet the view <table>. Nothing is read but footers; queries prune columns and push filters."""
    for t in tables or TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
