"""DBML text and Beam schemas as plain dictionaries."""

from __future__ import annotations

import hashlib
import uuid

from ..model import ColumnSpec, TableSpec, Type


def _dbml_type(c: ColumnSpec) -> str:
    if c.type is Type.DECIMAL:
        kind = f"DECIMAL({c.decimal.precision},{c.decimal.scale})"
    elif c.type is Type.NESTED:
        kind = "Struct(" + ", ".join(f"{f.name} {_dbml_type(f)}" for f in c.fields) + ")"
    elif c.type in (Type.ARRAY, Type.SET):
        kind = f"{c.type.name.title()}({_dbml_type(c.fields[0])})"
    elif c.type is Type.MAP:
        kind = f"Map({_dbml_type(c.fields[0])}, {_dbml_type(c.fields[1])})"
    else:
        kind = c.type.name.replace("_", "")
    return f"{kind}[]" if c.is_repeated else kind


def to_dbml(t: TableSpec, name: str | None = None) -> str:
    """A DBML table; references name the tables that columns join."""
    ids, lines, refs = t.ids(), [], []
    for c in t.columns:
        notes = [] if c.is_optional else ["not null"]
        if ids == [c.name]:
            notes.append("primary key")
        if c.comment:
            notes.append(f"note: '{c.comment}'")
        lines.append(f'  {c.name} "{_dbml_type(c)}"' + (f" [{', '.join(notes)}]" if notes else ""))
        if c.join_reference:
            refs.append(f"Ref: {name or t.name}.{c.name} > {c.join_reference}.{c.name}")
    if len(ids) > 1:
        lines.append(f"  indexes {{\n    ({', '.join(ids)}) [pk]\n  }}")
    return f"Table {name or t.name} {{\n" + "\n".join(lines) + "\n}\n" + "".join(r + "\n" for r in refs)


_BEAM = {
    Type.STRING: "STRING", Type.BYTES: "BYTES", Type.BOOLEAN: "BOOLEAN", Type.INT_8: "BYTE", Type.INT_16: "INT16", Type.INT_32: "INT32", Type.INT_64: "INT64", Type.UINT_8: "BYTE", Type.UINT_16: "INT16",
    Type.UINT_32: "INT32", Type.UINT_64: "INT64", Type.FLOAT_32: "FLOAT", Type.FLOAT_64: "DOUBLE",
}
_LOGICAL = {Type.DATE: "beam:logical_type:date:v1", Type.DATETIME_64: "beam:logical_type:datetime:v1", Type.DECIMAL: "beam:logical_type:decimal:v1"}


def _beam_type(c: ColumnSpec) -> dict:
    if c.type in _BEAM:
        kind: dict = {"atomic_type": _BEAM[c.type]}
    elif c.type in _LOGICAL:
        kind = {"logical_type": {"urn": _LOGICAL[c.type]}}
        if c.decimal:
            kind["logical_type"]["argument"] = [c.decimal.precision, c.decimal.scale]
    elif c.type is Type.NESTED:
        kind = {"row_type": {"schema": _beam_schema(c.struct_name or c.name, c.fields)}}
    elif c.type is Type.MAP:
        kind = {"map_type": {"key_type": _beam_type(c.fields[0]), "value_type": _beam_type(c.fields[1])}}
    else:
        kind = {"array_type": {"element_type": _beam_type(c.fields[0])}}
    if c.is_repeated:
        kind = {"array_type": {"element_type": kind}}
    return {**kind, "nullable": True} if c.is_optional else kind


def _beam_schema(name: str, columns: tuple[ColumnSpec, ...]) -> dict:
    return {"id": str(uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])), "fields": [{"name": c.name, "id": i, "type": _beam_type(c)} for i, c in enumerate(columns)]}


def to_beam(t: TableSpec) -> dict:
    """A Beam schema as a dictionary; its id follows from the name."""
    return _beam_schema(t.full_name, t.columns)
