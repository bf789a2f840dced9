"""CREATE TABLE statements."""

from __future__ import annotations

from ..bridge import _element
from ..model import ColumnSpec, Compression, TableSpec, Timestamp, Type

_ENGINES = {"MERGE_TREE": "MergeTree", "LOG": "Log", "TINY_LOG": "TinyLog", "REPLICATED_MERGE_TREE": "ReplicatedMergeTree"}
_NAMES = {Type.STRING: "String", Type.BYTES: "String", Type.BOOLEAN: "UInt8", Type.DATE: "Date", Type.FLOAT_32: "Float32", Type.FLOAT_64: "Float64"}


def _clickhouse_value(c: ColumnSpec) -> str:
    if c.sql_type:
        return c.sql_type
    if c.type in _NAMES:
        return _NAMES[c.type]
    if c.type.name.startswith(("INT_", "UINT_")):
        sign, width = c.type.name.split("_")
        return ("UInt" if sign == "UINT" else "Int") + width
    if c.type is Type.DECIMAL:
        size = next(s for limit, s in ((9, 32), (18, 64), (38, 128), (76, 256)) if c.decimal.precision <= limit)
        return f"Decimal{size}({c.decimal.scale})"
    if c.type is Type.DATETIME_64:
        t = c.timestamp or Timestamp()
        return f'DateTime64({t.precision}, "{t.timezone}")'
    if c.type in (Type.ARRAY, Type.SET):
        return f"Array({clickhouse_type(c.fields[0])})"
    if c.type is Type.MAP:
        return f"Map({clickhouse_type(c.fields[0])}, {clickhouse_type(c.fields[1])})"
    if c.type is Type.NESTED:
        inner = ", ".join(f"{f.sql_name or f.name} {clickhouse_type(f)}" for f in c.fields)
        return f"{'Nested' if c.nested_type == 'NESTED' or (c.is_repeated and c.nested_type is None) else 'Tuple'}({inner})"
    raise ValueError(f"no ClickHouse type for {c.type} of `{c.name}`")


def clickhouse_type(c: ColumnSpec) -> str:
    kind = _clickhouse_value(c)
    if c.is_optional and c.type not in (Type.NESTED, Type.ARRAY, Type.SET, Type.MAP):
        kind = f"Nullable({kind})"
    if c.low_cardinality:
        kind = f"LowCardinality({kind})"
    if c.is_repeated and not kind.startswith("Nested("):
        kind = f"Array({kind})"
    return kind


def _codec(c: ColumnSpec, default: Compression | None) -> str:
    parts = [f"Delta({c.delta})"] if c.delta else []
    comp = c.compression or default
    if comp and not (parts == [] and c.compression is None and comp.codec == "LZ4"):
        parts.append(comp.codec + (f"({comp.level})" if comp.level is not None else ""))
    elif parts:
        parts.append("LZ4")
    return f" CODEC({', '.join(parts)})" if parts else ""


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clickhouse_ddl(t: TableSpec, name: str | None = None, database: str | None = None, if_not_exists: bool = False, replication: list[str] | None = None) -> str:
    lines = []
    for c in t.columns:
        comment = f" COMMENT {_quoted(c.comment)}" if c.comment else ""
        lines.append(f"  {c.sql_name or c.name} {clickhouse_type(c)}{comment}{_codec(c, t.compression)}")
    where = ".".join(x for x in (database, name or t.name) if x)
    args = ", ".join(_quoted(x) for x in replication or t.replication)
    out = f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{where} (\n" + ",\n".join(lines) + "\n)\n"
    out += f"ENGINE = {_ENGINES[t.engine or 'MERGE_TREE']}({args})"
    for word, xs in (("ORDER BY", t.order_by), ("PARTITION BY", t.partition_by), ("SAMPLE BY", t.sample_by)):
        if xs:
            out += f"\n{word} ({', '.join(xs)})"
    if not t.order_by and (t.engine or "MERGE_TREE").endswith("MERGE_TREE"):
        out += "\nORDER BY tuple()"
    if t.index_granularity is not None:
        out += f"\nSETTINGS index_granularity = {t.index_granularity}"
    if t.comment:
        out += f"\nCOMMENT {_quoted(t.comment)}"
    return out


def spark_ddl(t: TableSpec, name: str | None = None, fmt: str = "parquet") -> str:
    """CREATE TABLE for Spark; order and partition columns become clauses where they are plain columns."""
    lines = [f"  `{c.name}` {_element(c).simpleString()}{'' if c.is_optional else ' NOT NULL'}" + (f" COMMENT {_quoted(c.comment)}" if c.comment else "") for c in t.columns]
    out = f"CREATE TABLE {name or t.name} (\n" + ",\n".join(lines) + f"\n)\nUSING {fmt}"
    plain = [x for x in t.partition_by if x in t.names()]
    if plain:
        out += f"\nPARTITIONED BY ({', '.join(plain)})"
    return out + (f"\nCOMMENT {_quoted(t.comment)}" if t.comment else "")


_ANSI = {
    Type.STRING: "VARCHAR", Type.BYTES: "VARBINARY", Type.BOOLEAN: "BOOLEAN", Type.INT_8: "SMALLINT", Type.INT_16: "SMALLINT", Type.INT_32: "INTEGER", Type.INT_64: "BIGINT", Type.UINT_8: "SMALLINT",
    Type.UINT_16: "INTEGER", Type.UINT_32: "BIGINT", Type.UINT_64: "DECIMAL(20, 0)", Type.FLOAT_32: "REAL", Type.FLOAT_64: "DOUBLE PRECISION", Type.DATE: "DATE", Type.DATETIME_64: "TIMESTAMP", Type.NESTED: "JSON", Type.MAP: "JSON",
}


def ansi_ddl(t: TableSpec, name: str | None = None) -> str:
    """CREATE TABLE with a primary key; all columns are the key if none is marked."""

    def kind(c: ColumnSpec) -> str:
        if c.is_repeated or c.type in (Type.ARRAY, Type.SET):
            return (kind(c.fields[0]) if c.fields and not c.is_repeated else kind(c.with_(label=type(c.label).REQUIRED))) + " ARRAY"
        if c.type is Type.DECIMAL:
            return f"DECIMAL({c.decimal.precision}, {c.decimal.scale})"
        return f"VARCHAR({c.width})" if c.type is Type.STRING and c.width else _ANSI[c.type]

    ids = t.ids() or t.names()
    lines = [f"  {c.name} {kind(c)}{'' if c.is_optional else ' NOT NULL'}" for c in t.columns] + [f"  PRIMARY KEY ({', '.join(ids)})"]
    return f"CREATE TABLE {name or t.name} (\n" + ",\n".join(lines) + "\n)"
