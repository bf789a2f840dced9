"""One table model: logical types, labels and annotations, which every other schema language maps to and from."""

from __future__ import annotations

import dataclasses
import enum
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any


class Type(enum.Enum):
    """Logical types; Spark lacks some (unsigned, sets), which stay in field metadata."""

    UNDEFINED = 0
    STRING = 1
    BYTES = 2
    BOOLEAN = 3
    INT_8 = 4
    INT_16 = 5
    INT_32 = 6
    INT_64 = 7
    UINT_8 = 8
    UINT_16 = 9
    UINT_32 = 10
    UINT_64 = 11
    DECIMAL = 12
    FLOAT_32 = 13
    FLOAT_64 = 14
    DATE = 15
    DATETIME_64 = 16
    NESTED = 17
    ARRAY = 18
    SET = 19
    MAP = 20


class Label(enum.Enum):
    UNDEFINED = 0
    REQUIRED = 1
    OPTIONAL = 2
    REPEATED = 3


INTEGERS = {Type.INT_8: 8, Type.INT_16: 16, Type.INT_32: 32, Type.INT_64: 64}
UNSIGNED = {Type.UINT_8: 8, Type.UINT_16: 16, Type.UINT_32: 32, Type.UINT_64: 64}
MAX_PRECISION = 76


@dataclass(frozen=True)
class Decimal:
    precision: int
    scale: int = 0


@dataclass(frozen=True)
class Timestamp:
    precision: int = 6
    timezone: str = "Etc/UTC"


@dataclass(frozen=True)
class Compression:
    codec: str  # LZ4, LZ4HC, ZSTD, NONE
    level: int | None = None


@dataclass(frozen=True)
class Quality:
    """What the data must meet: nulls, a format, allowed values, a pattern."""

    nullable: bool | None = None
    ignored: bool = False
    format: str | None = None
    values: tuple[str, ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: Type
    label: Label = Label.REQUIRED
    fields: tuple[ColumnSpec, ...] = ()
    decimal: Decimal | None = None
    timestamp: Timestamp | None = None
    is_id: bool = False
    comment: str | None = None
    width: int | None = None
    is_lob: bool = False
    low_cardinality: bool = False
    compression: Compression | None = None
    delta: int | None = None
    sql_name: str | None = None
    sql_type: str | None = None
    nested_type: str | None = None  # NESTED or TUPLE
    code_name: str | None = None
    code_type: str | None = None
    initializer: str | None = None
    struct_name: str | None = None
    join_reference: str | None = None
    quality: Quality | None = None
    deprecated: bool = False
    synth: Any = None

    @property
    def is_repeated(self) -> bool:
        return self.label is Label.REPEATED

    @property
    def is_optional(self) -> bool:
        return self.label is Label.OPTIONAL

    def with_(self, **changes) -> ColumnSpec:
        return replace(self, **changes)

    def walk(self) -> Iterator[ColumnSpec]:
        yield self
        for f in self.fields:
            yield from f.walk()


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    package: str = ""
    comment: str | None = None
    engine: str | None = None  # MERGE_TREE, LOG, TINY_LOG, REPLICATED_MERGE_TREE
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    sample_by: tuple[str, ...] = ()
    index_granularity: int | None = None
    compression: Compression | None = None
    entity: bool = False
    source: str = ""
    replication: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))

    def column(self, path: str) -> ColumnSpec:
        """The column of a dotted path."""
        at: tuple[ColumnSpec, ...] = self.columns
        found = None
        for part in path.split("."):
            found = next((c for c in at if c.name == part), None)
            if found is None:
                raise KeyError(path)
            at = found.fields
        return found

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def pick(self, names: list[str]) -> TableSpec:
        return replace(self, columns=tuple(self.column(n) for n in names))

    def ids(self) -> list[str]:
        return [c.name for c in self.columns if c.is_id]

    @property
    def full_name(self) -> str:
        return f"{self.package}.{self.name}" if self.package else self.name


# Validation

_CODECS = {"LZ4", "LZ4HC", "ZSTD", "NONE"}


def validate_column(c: ColumnSpec, owner: str = "") -> list[str]:
    """What is wrong with a column; an empty list if nothing is."""
    where, out = f"`{c.name}` of `{owner}`", []
    if c.type is Type.UNDEFINED:
        out.append(f"undefined type for {where}")
    if c.label is Label.UNDEFINED:
        out.append(f"undefined label for {where}")
    if c.fields and c.type not in (Type.ARRAY, Type.SET, Type.MAP, Type.NESTED):
        out.append(f"sub-fields in a column without structure, {where}")
    if c.type in (Type.ARRAY, Type.SET) and len(c.fields) != 1:
        out.append(f"one element is needed in {where}")
    if c.type is Type.MAP and len(c.fields) != 2:
        out.append(f"a key and a value are needed in {where}")
    if c.type is Type.DECIMAL:
        if c.decimal is None:
            out.append(f"decimal annotation missing for {where}")
        elif not 0 <= c.decimal.precision <= MAX_PRECISION:
            out.append(f"decimal precision {c.decimal.precision} is out of range for {where}")
        elif c.decimal.scale > c.decimal.precision:
            out.append(f"decimal scale {c.decimal.scale} exceeds the precision for {where}")
    elif c.decimal is not None:
        out.append(f"decimal annotation for a column that is none, {where}")
    if c.timestamp is not None:
        if c.type is not Type.DATETIME_64:
            out.append(f"timestamp annotation for a column that is none, {where}")
        elif c.timestamp.precision not in (0, 3, 6, 9):
            out.append(f"timestamp precision {c.timestamp.precision} is none of 0, 3, 6, 9 for {where}")
    if c.low_cardinality and c.type is not Type.STRING:
        out.append(f"low cardinality for a column that is no string, {where}")
    if c.delta is not None:
        if c.type not in (*INTEGERS, *UNSIGNED, Type.DATE, Type.DATETIME_64):
            out.append(f"delta compression for a type that has no differences, {where}")
        elif c.delta not in (1, 2, 4, 8):
            out.append(f"delta of {c.delta} bytes is none of 1, 2, 4, 8 for {where}")
    if c.compression is not None:
        if c.compression.codec not in _CODECS:
            out.append(f"unknown compression {c.compression.codec} for {where}")
        if c.compression.level is not None and c.compression.codec != "ZSTD":
            out.append(f"compression level without ZSTD for {where}")
    if c.width is not None and c.type not in (Type.STRING, Type.BYTES):
        out.append(f"width for a column without length, {where}")
    for f in c.fields:
        out += validate_column(f, f"{owner}.{c.name}")
    return out


def validate(t: TableSpec) -> list[str]:
    """What is wrong with a table."""
    out = [x for c in t.columns for x in validate_column(c, t.full_name)]
    seen: set[str] = set()
    for c in t.columns:
        if c.name in seen:
            out.append(f"column `{c.name}` is repeated in `{t.full_name}`")
        seen.add(c.name)
    ordered = t.engine in (None, "MERGE_TREE", "REPLICATED_MERGE_TREE")
    by_name = {c.name: c for c in t.columns}
    for clause, expressions in (("PARTITION BY", t.partition_by), ("SAMPLE BY", t.sample_by), ("ORDER BY", t.order_by)):
        if expressions and not ordered:
            out.append(f"{clause} doesn't go with engine {t.engine} of `{t.full_name}`")
        for x in expressions:
            if ")" not in x and x not in by_name:
                out.append(f"{clause} names `{x}`, which `{t.full_name}` doesn't have")
            elif x in by_name and by_name[x].label is not Label.REQUIRED:
                out.append(f"{clause} names `{x}` of `{t.full_name}`, which isn't required")
    if t.index_granularity is not None and not ordered:
        out.append(f"index granularity doesn't go with engine {t.engine} of `{t.full_name}`")
    return out


def check(t: TableSpec) -> TableSpec:
    """t itself; ValueError if something is wrong with it."""
    if problems := validate(t):
        raise ValueError("; ".join(problems))
    return t


def asdict(x: TableSpec | ColumnSpec) -> dict:
    """A JSON form without defaults."""
    out = {}
    for f in dataclasses.fields(x):
        v = getattr(x, f.name)
        if v == f.default or v == ():
            continue
        if isinstance(v, enum.Enum):
            v = v.name
        elif f.name in ("columns", "fields"):
            v = [asdict(c) for c in v]
        elif dataclasses.is_dataclass(v):
            v = dataclasses.asdict(v)
        elif isinstance(v, tuple):
            v = list(v)
        out[f.name] = v
    return out


def column_from_dict(d: dict) -> ColumnSpec:
    d = dict(d)
    d["type"] = Type[d["type"]]
    if "label" in d:
        d["label"] = Label[d["label"]]
    d["fields"] = tuple(column_from_dict(x) for x in d.get("fields", ()))
    for name, kind in (("decimal", Decimal), ("timestamp", Timestamp), ("compression", Compression)):
        if d.get(name):
            d[name] = kind(**d[name])
    if d.get("quality"):
        d["quality"] = Quality(**{**d["quality"], "values": tuple(d["quality"].get("values", ()))})
    return ColumnSpec(**d)


def table_from_dict(d: dict) -> TableSpec:
    d = dict(d)
    d["columns"] = tuple(column_from_dict(c) for c in d.get("columns", ()))
    for name in ("order_by", "partition_by", "sample_by", "replication"):
        if name in d:
            d[name] = tuple(d[name])
    if d.get("compression"):
        d["compression"] = Compression(**d["compression"])
    return TableSpec(**d)
