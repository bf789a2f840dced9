"""Source text of Scala case classes and Python dataclasses."""

from __future__ import annotations

import keyword
import re

from ..model import ColumnSpec, TableSpec, Type

_SCALA = {
    Type.STRING: "String", Type.BYTES: "ByteBuffer", Type.BOOLEAN: "Boolean", Type.INT_8: "Byte", Type.INT_16: "Int", Type.INT_32: "Int", Type.INT_64: "Long", Type.UINT_8: "Int", Type.UINT_16: "Int",
    Type.UINT_32: "Long", Type.UINT_64: "BigInt", Type.FLOAT_32: "Float", Type.FLOAT_64: "Double", Type.DATE: "Date", Type.DATETIME_64: "Timestamp",
}
_IMPORTS = {"ByteBuffer": "java.nio.ByteBuffer", "Date": "java.sql.Date", "Timestamp": "java.sql.Timestamp", "Decimal": "org.apache.spark.sql.types.Decimal"}
_SCALA_WORDS = set("abstract case catch class def do else extends false final finally for forSome if implicit import lazy match new null object override package private protected return sealed super this throw trait try true type val var while with yield".split())


def _camel(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"\W|_", name) if p)


def _struct(c: ColumnSpec) -> str:
    return c.struct_name or _camel(c.name)


def _nested(columns: tuple[ColumnSpec, ...]) -> list[ColumnSpec]:
    """Nested structures below columns, innermost first, each name once."""
    out: dict[str, ColumnSpec] = {}
    for c in columns:
        for n in reversed([x for x in c.walk() if x.type is Type.NESTED]):
            out.setdefault(_struct(n), n)
    return list(out.values())


def _scala_type(c: ColumnSpec) -> str:
    if c.code_type:
        kind = c.code_type
    elif c.type is Type.DECIMAL:
        kind = "BigInt" if c.decimal.scale == 0 else "Decimal"
    elif c.type is Type.NESTED:
        kind = _struct(c)
    elif c.type in (Type.ARRAY, Type.SET):
        kind = f"{'Array' if c.type is Type.ARRAY else 'Set'}[{_scala_type(c.fields[0])}]"
    elif c.type is Type.MAP:
        kind = f"Map[{_scala_type(c.fields[0])}, {_scala_type(c.fields[1])}]"
    else:
        kind = _SCALA[c.type]
    return f"Option[{kind}]" if c.is_optional else f"Seq[{kind}]" if c.is_repeated else kind


def _scala_class(name: str, columns: tuple[ColumnSpec, ...], entity: bool = False) -> str:
    lines = []
    for c in columns:
        shown = c.code_name or c.name
        shown = f"`{shown}`" if shown in _SCALA_WORDS or not shown.isidentifier() else shown
        marks = ("@Id " if c.is_id and entity else "") + ("@deprecated " if c.deprecated else "")
        lines.append(f"  {marks}{shown}: {_scala_type(c)}" + (f" = {c.initializer}" if c.initializer else ""))
    return ("@Entity\n" if entity else "") + f"case class {name}(\n" + ",\n".join(lines) + "\n)"


def to_scala(t: TableSpec, package: str = "") -> str:
    """A case class per structure."""
    body = [_scala_class(_struct(n), n.fields) for n in _nested(t.columns)] + [_scala_class(_camel(t.name), t.columns, t.entity)]
    text = "\n\n".join(body)
    imports = sorted(v for k, v in _IMPORTS.items() if re.search(rf"\b{k}\b", text))
    head = [f"package {package or t.package}"] if package or t.package else []
    return "\n\n".join(head + (["\n".join(f"import {i}" for i in imports)] if imports else []) + [text]) + "\n"


_PY = {Type.STRING: "str", Type.BYTES: "bytes", Type.BOOLEAN: "bool", Type.INT_64: "int", Type.FLOAT_64: "float", Type.DATE: "datetime.date", Type.DATETIME_64: "datetime.datetime", Type.DECIMAL: "decimal.Decimal"}


def _py_type(c: ColumnSpec) -> str:
    notes = []
    if c.type is Type.NESTED:
        kind = _struct(c)
    elif c.type in (Type.ARRAY, Type.SET):
        kind = f"{'list' if c.type is Type.ARRAY else 'set'}[{_py_type(c.fields[0])}]"
        if c.type is Type.ARRAY and not c.is_optional and not c.fields[0].is_optional and c.fields[0].type not in (Type.ARRAY, Type.SET, Type.MAP):
            notes.append('"array": True')
    elif c.type is Type.MAP:
        kind = f"dict[{_py_type(c.fields[0])}, {_py_type(c.fields[1])}]"
    elif c.type in _PY:
        kind = _PY[c.type]
    else:
        kind = "float" if c.type is Type.FLOAT_32 else "int"
        notes.append(f'"type": Type.{c.type.name}')
    for name in ("decimal", "timestamp", "compression", "quality", "is_id", "comment", "width", "is_lob", "low_cardinality", "delta", "sql_name", "sql_type", "nested_type", "code_name", "join_reference", "deprecated"):
        value = getattr(c, name)
        if value and not (name == "timestamp" and value.precision == 6 and value.timezone == "Etc/UTC"):
            notes.append(f'"{name}": {value!r}')
    value_notes = f"typing.Annotated[{kind}, {{{', '.join(notes)}}}]" if notes else kind
    return f"list[{value_notes}]" if c.is_repeated else f"typing.Optional[{value_notes}]" if c.is_optional else value_notes


def _py_class(name: str, columns: tuple[ColumnSpec, ...]) -> str:
    lines = [f"    {c.name + '_' if keyword.iskeyword(c.name) else c.name}: {_py_type(c)}" for c in columns]
    return f"@dataclasses.dataclass\nclass {name}:\n" + "\n".join(lines or ["    pass"])


def to_dataclass(t: TableSpec) -> str:
    """A dataclass per structure, with annotations that read back as the same model."""
    head = "import dataclasses\nimport datetime\nimport decimal\nimport typing\n\nfrom flowschema.model import Compression, Decimal, Quality, Timestamp, Type"
    return "\n\n\n".join([head, *(_py_class(_struct(n), n.fields) for n in _nested(t.columns)), _py_class(_camel(t.name), t.columns)]) + "\n"
