"""Input and output tables of statements, of many files, and schema hints in comments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sql.lexer import SqlError
from .graph import lineage


@dataclass(frozen=True)
class Endpoints:
    inputs: list[str]
    outputs: list[str]


def endpoints(text: str, dialect: str = "spark") -> Endpoints:
    """Tables that a text reads from outside (a table that it makes itself and reads later is both) and that it fills."""
    g = lineage(text, dialect)
    return Endpoints(g.inputs(), g.outputs())


def schema_hints(text: str) -> dict[str, str]:
    """`--@Schema: table Name` and `--@Output: Name` in comments: table (or "" for the output) to schema name."""
    out = {m[1]: m[2] for m in re.finditer(r"^\s*--\s*@Schema:\s*(\S+)\s+(\S+)\s*$", text, re.M)}
    if m := re.search(r"^\s*--\s*@Output:\s*(\S+)\s*$", text, re.M):
        out[""] = m[1]
    return out


def _rows(batches: Iterator[pa.RecordBatch], dialect: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"file": [], "role": [], "name": [], "error": []}
        for path, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist()):
            try:
                e = endpoints(text, dialect)
                found = [("input", n, None) for n in e.inputs] + [("output", n, None) for n in e.outputs]
            except SqlError as x:
                found = [("error", None, str(x))]
            for role, name, error in found:
                for k, v in zip(out, (path, role, name, error)):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})


def endpoints_of_files(spark: SparkSession, paths: str | list[str], dialect: str = "spark") -> DataFrame:
    """file, role (input, output, error), name, error for every SQL file: files are parsed where they are read."""
    texts = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).selectExpr("_metadata.file_path AS file", "value AS text")
    return texts.mapInArrow(lambda batches: _rows(batches, dialect), "file string, role string, name string, error string")
