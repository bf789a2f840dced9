"""Generators for whole tables, from their schema: defaults by type, names, join keys, order of tables.

A spec is found for a column in this order: explicit by path, the column's own annotation, a regular expression that matches the
path fully, else by type. Columns that share name and type across tables are one key: the table where it is the id owns it and
the others draw from its keys. Nothing is shared at run time: a foreign key is the owner's generator at another index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bridge import _element, loose
from ..model import INTEGERS, UNSIGNED, ColumnSpec, TableSpec, Type
from .generators import Generator, Row, build

NULL_SHARE = 0.05
LENGTH = ("int", 2, 6)


def default_spec(c: ColumnSpec) -> Any:
    """The spec of one value by its type."""
    if c.is_id and (c.type in INTEGERS or c.type in UNSIGNED):
        return ("inc", 1)
    if c.is_id and c.type is Type.STRING:
        return ("format", c.name + "_{}", ("inc", 1))
    if c.type in INTEGERS:
        return ("int", 0, 126 if c.type is Type.INT_8 else 32766)
    if c.type in UNSIGNED:
        return ("int", 0, 254 if c.type is Type.UINT_8 else 65534)
    if c.type is Type.STRING:
        return ("str", c.width or 8)
    if c.type is Type.BYTES:
        return ("tobytes", ("str", 8))
    if c.type is Type.BOOLEAN:
        return ("tobool", ("int", 0, 2))
    if c.type in (Type.FLOAT_32, Type.FLOAT_64):
        return ("uniform", 0.0, 100.0)
    if c.type is Type.DATE:
        return ("date", "2010-01-01", ("inc", 1) if c.is_id else ("int", 0, 3652))
    if c.type is Type.DATETIME_64:
        return ("datetime", "2010-01-01 00:00:00", ("inc", 1) if c.is_id else ("int", 0, 3652 * 86400))
    if c.type is Type.DECIMAL:
        return ("todecimal", ("format", "{}.{:02d}", ("int", 0, min(10 ** max(c.decimal.precision - c.decimal.scale, 1), 32766)), ("int", 0, 100)), c.decimal.precision, c.decimal.scale)
    raise ValueError(f"no default generator for {c.type} of `{c.name}`")


@dataclass
class TableGenerator:
    """Generates one table of count rows."""

    table: TableSpec
    count: int
    specs: dict[str, Any] = field(default_factory=dict)  # by path, or regular expression
    seed: int = 42
    joints: dict[str, tuple[str, Any, int | None]] = field(default_factory=dict)  # path: (key name, owner's spec, owner's rows or None for the owner)

    def _spec(self, c: ColumnSpec, path: str) -> tuple[Any, bool]:
        if path in self.specs:
            return self.specs[path], True
        if c.synth is not None:
            return c.synth, True
        for pattern, spec in self.specs.items():
            if re.fullmatch(pattern, path):
                return spec, True
        return None, False

    def generator(self, c: ColumnSpec, path: str) -> Generator:
        if path in self.joints:
            name, spec, rows = self.joints[path]
            return build(("joint", spec, name) if rows is None else ("joint", spec, name, rows))
        spec, explicit = self._spec(c, path)
        if explicit:
            g = build(spec)
        elif c.type is Type.NESTED:
            g = self.structure(c.fields, path)
        elif c.type in (Type.ARRAY, Type.SET):
            g = build(("set" if c.type is Type.SET else "array", self.generator(c.fields[0].with_(name="element"), f"{path}.element"), LENGTH))
        elif c.type is Type.MAP:
            g = build(("dict", self.generator(c.fields[0], f"{path}.key"), self.generator(c.fields[1], f"{path}.value"), LENGTH))
        else:
            g = build(default_spec(c))
        if c.is_repeated and not explicit:
            g = build(("array", g, LENGTH))
        if c.is_optional and not explicit:
            inner = g
            g = lambda row: F.when(row.uniform("null") >= NULL_SHARE, inner(row))
        return g

    def structure(self, columns: tuple[ColumnSpec, ...], prefix: str) -> Generator:
        gens = {c.name: self.generator(c, f"{prefix}.{c.name}" if prefix else c.name) for c in columns}
        return lambda row: F.struct(*(g(row.at(n, siblings=gens)).alias(n) for n, g in gens.items()))

    def frame(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        """The table: a range of row indexes and one projection; its values are the same for any number of partitions."""
        gens = {c.name: self.generator(c, c.name) for c in self.table.columns}
        rows = spark.range(0, self.count, 1, partitions) if partitions else spark.range(self.count)
        row = Row(F.col("id"), self.table.name, self.seed, siblings=gens)
        return rows.select(*(gens[c.name](row.at(c.name)).cast(loose(_element(c))).alias(c.name) for c in self.table.columns))


def _leaves(columns: tuple[ColumnSpec, ...], prefix: str = "") -> list[tuple[str, ColumnSpec]]:
    out = []
    for c in columns:
        path = f"{prefix}.{c.name}" if prefix else c.name
        if c.type is Type.NESTED and not c.is_repeated:
            out += _leaves(c.fields, path)
        elif not c.fields and not c.is_repeated:
            out.append((path, c))
    return out


def find_joints(tables: list[TableSpec]) -> dict[str, dict[str, tuple[str, str | None]]]:
    """For each table, paths that share a key: (key, owner table). Same last name and type in two or more places, one of which is an id."""
    places: dict[tuple[str, Type], list[tuple[str, str, ColumnSpec]]] = {}
    for t in tables:
        for path, c in _leaves(t.columns):
            places.setdefault((c.name, c.type), []).append((t.name, path, c))
    out: dict[str, dict[str, tuple[str, str | None]]] = {t.name: {} for t in tables}
    for (name, kind), found in places.items():
        if len(found) < 2:
            continue
        owner = next((t for t, path, c in found if c.is_id and "." not in path), None)
        for t, path, _ in found:
            if owner is not None:
                out[t][path] = (f"{name}:{kind.name}", owner)
    return out


def table_order(tables: list[TableSpec], joints: dict[str, dict[str, tuple[str, str | None]]]) -> list[str]:
    """Names of tables, owners of keys first."""
    needs = {t.name: {o for _, o in joints[t.name].values() if o and o != t.name} for t in tables}
    out: list[str] = []
    while needs:
        ready = [n for n in needs if needs[n] <= set(out)]
        if not ready:
            raise ValueError(f"tables need each other's keys: {sorted(needs)}")
        for n in ready:
            out.append(n)
            del needs[n]
    return out


def generate_tables(spark: SparkSession, tables: list[TableSpec], counts: dict[str, int] | int = 1000, specs: dict[str, dict[str, Any]] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """A DataFrame for each table, in an order in which keys exist before they are referred to."""
    specs, joints = specs or {}, find_joints(tables)
    count = lambda n: counts if isinstance(counts, int) else counts.get(n, 1000)
    by_name = {t.name: t for t in tables}
    owners: dict[str, Any] = {}
    for t in tables:
        for path, (key, owner) in joints[t.name].items():
            if owner == t.name and "." not in path and t.column(path).is_id:
                owners[key] = specs.get(t.name, {}).get(path) or t.column(path).synth or default_spec(t.column(path))
    out = {}
    for name in table_order(tables, joints):
        own = {}
        for path, (key, owner) in joints[name].items():
            is_owner = owner == name and "." not in path and by_name[name].column(path).is_id
            own[path] = (key, owners[key], None if is_owner else count(owner))
        out[name] = TableGenerator(by_name[name], count(name), specs.get(name, {}), seed, own).frame(spark)
    return out
