"""The table model to and from Spark, Arrow, pandas and Python dataclasses."""

from __future__ import annotations

import collections.abc
import dataclasses
import datetime
import decimal
import json
import types
import typing

from pyspark.sql import types as S

from .model import UNSIGNED, ColumnSpec, Decimal, Label, TableSpec, Timestamp, Type, asdict, column_from_dict

METADATA = "flowschema"
_SPARK = {
    Type.STRING: S.StringType(), Type.BYTES: S.BinaryType(), Type.BOOLEAN: S.BooleanType(), Type.INT_8: S.ByteType(), Type.INT_16: S.ShortType(), Type.INT_32: S.IntegerType(), Type.INT_64: S.LongType(),
    Type.UINT_8: S.ShortType(), Type.UINT_16: S.IntegerType(), Type.UINT_32: S.LongType(), Type.UINT_64: S.DecimalType(20, 0), Type.FLOAT_32: S.FloatType(), Type.FLOAT_64: S.DoubleType(),
    Type.DATE: S.DateType(), Type.DATETIME_64: S.TimestampType(),
}


def spark_type(c: ColumnSpec) -> S.DataType:
    """The Spark type of one value of c (a repeated column is an array of it)."""
    if c.type in _SPARK:
        return _SPARK[c.type]
    if c.type is Type.DECIMAL:
        if c.decimal is None:
            raise ValueError(f"decimal annotation missing for `{c.name}`")
        return S.DecimalType(min(c.decimal.precision, 38), c.decimal.scale)
    if c.type is Type.NESTED:
        return S.StructType([spark_field(f) for f in c.fields])
    if c.type in (Type.ARRAY, Type.SET):
        return S.ArrayType(_element(c.fields[0]), c.fields[0].is_optional)
    if c.type is Type.MAP:
        return S.MapType(_element(c.fields[0]), _element(c.fields[1]), c.fields[1].is_optional)
    raise ValueError(f"no Spark type for {c.type} of `{c.name}`")


def _element(c: ColumnSpec) -> S.DataType:
    return S.ArrayType(spark_type(c), False) if c.is_repeated else spark_type(c)


def loose(kind: S.DataType) -> S.DataType:
    """kind with nulls allowed inside: a cast can't promise that there are none."""
    if isinstance(kind, S.ArrayType):
        return S.ArrayType(loose(kind.elementType), True)
    if isinstance(kind, S.MapType):
        return S.MapType(loose(kind.keyType), loose(kind.valueType), True)
    if isinstance(kind, S.StructType):
        return S.StructType([S.StructField(f.name, loose(f.dataType), True) for f in kind.fields])
    return kind


def spark_field(c: ColumnSpec) -> S.StructField:
    return S.StructField(c.name, _element(c), c.is_optional, {METADATA: json.dumps(asdict(c), default=str)})


def to_spark(t: TableSpec) -> S.StructType:
    """StructType with the whole model in the metadata of its fields."""
    return S.StructType([spark_field(c) for c in t.columns])


_FROM_SPARK = {S.StringType: Type.STRING, S.VarcharType: Type.STRING, S.CharType: Type.STRING, S.BinaryType: Type.BYTES, S.BooleanType: Type.BOOLEAN, S.ByteType: Type.INT_8, S.ShortType: Type.INT_16, S.IntegerType: Type.INT_32, S.LongType: Type.INT_64, S.FloatType: Type.FLOAT_32, S.DoubleType: Type.FLOAT_64, S.DateType: Type.DATE}


def column_from_spark(name: str, kind: S.DataType, nullable: bool = True) -> ColumnSpec:
    label = Label.OPTIONAL if nullable else Label.REQUIRED
    if isinstance(kind, S.DecimalType):
        return ColumnSpec(name, Type.DECIMAL, label, decimal=Decimal(kind.precision, kind.scale))
    if isinstance(kind, (S.TimestampType, S.TimestampNTZType)):
        return ColumnSpec(name, Type.DATETIME_64, label, timestamp=Timestamp(6, "Etc/UTC"))
    if isinstance(kind, S.StructType):
        return ColumnSpec(name, Type.NESTED, label, tuple(from_field(f) for f in kind.fields))
    if isinstance(kind, S.ArrayType):
        inner = column_from_spark("element", kind.elementType, kind.containsNull)
        if nullable or kind.containsNull or isinstance(kind.elementType, (S.ArrayType, S.MapType)):
            return ColumnSpec(name, Type.ARRAY, label, (inner,))
        return inner.with_(name=name, label=Label.REPEATED)
    if isinstance(kind, S.MapType):
        return ColumnSpec(name, Type.MAP, label, (column_from_spark("key", kind.keyType, False), column_from_spark("value", kind.valueType, kind.valueContainsNull)))
    if type(kind) not in _FROM_SPARK:
        raise ValueError(f"no logical type for {kind.simpleString()} of `{name}`")
    return ColumnSpec(name, _FROM_SPARK[type(kind)], label)


def from_field(f: S.StructField) -> ColumnSpec:
    """The model in the metadata of a field, if it still describes the field; else what its type says."""
    kept = (f.metadata or {}).get(METADATA)
    if kept:
        c = column_from_dict(json.loads(kept))
        if c.name == f.name and spark_field(c).dataType == f.dataType:
            return c
    return column_from_spark(f.name, f.dataType, f.nullable)


def from_spark(schema: S.StructType, name: str = "table", package: str = "") -> TableSpec:
    return TableSpec(name, tuple(from_field(f) for f in schema.fields), package, source="PYSPARK")


# Arrow and pandas


def arrow_type(c: ColumnSpec, no_uint: bool = False):
    import pyarrow as pa

    plain = {
        Type.BOOLEAN: pa.bool_(), Type.INT_8: pa.int8(), Type.INT_16: pa.int16(), Type.INT_32: pa.int32(), Type.INT_64: pa.int64(), Type.FLOAT_32: pa.float32(), Type.FLOAT_64: pa.float64(), Type.DATE: pa.date32(),
        Type.UINT_8: pa.int16() if no_uint else pa.uint8(), Type.UINT_16: pa.int32() if no_uint else pa.uint16(), Type.UINT_32: pa.int64() if no_uint else pa.uint32(),
        Type.UINT_64: pa.decimal128(20, 0) if no_uint else pa.uint64(), Type.STRING: pa.large_string() if c.is_lob else pa.string(), Type.BYTES: pa.large_binary() if c.is_lob else pa.binary(),
    }
    if c.type in plain:
        return plain[c.type]
    if c.type is Type.DECIMAL:
        return (pa.decimal128 if c.decimal.precision <= 38 else pa.decimal256)(c.decimal.precision, c.decimal.scale)
    if c.type is Type.DATETIME_64:
        t = c.timestamp or Timestamp()
        return pa.timestamp({0: "s", 3: "ms", 6: "us", 9: "ns"}[t.precision], t.timezone)
    if c.type is Type.NESTED:
        return pa.struct([arrow_field(f, no_uint) for f in c.fields])
    if c.type in (Type.ARRAY, Type.SET):
        return pa.list_(arrow_field(c.fields[0].with_(name="element"), no_uint))
    if c.type is Type.MAP:
        return pa.map_(arrow_field(c.fields[0].with_(name="key"), no_uint).type, arrow_field(c.fields[1].with_(name="value"), no_uint))
    raise ValueError(f"no Arrow type for {c.type} of `{c.name}`")


def arrow_field(c: ColumnSpec, no_uint: bool = False):
    import pyarrow as pa

    kind = arrow_type(c, no_uint)
    if c.is_repeated:
        kind = pa.list_(pa.field("element", kind, nullable=False))
    return pa.field(c.name, kind, nullable=c.is_optional)


def to_arrow(t: TableSpec, no_uint: bool = False):
    import pyarrow as pa

    return pa.schema([arrow_field(c, no_uint) for c in t.columns])


def column_from_arrow(f) -> ColumnSpec:
    import pyarrow as pa
    import pyarrow.types as P

    k, label = f.type, Label.OPTIONAL if f.nullable else Label.REQUIRED
    named = {pa.bool_(): Type.BOOLEAN, pa.int8(): Type.INT_8, pa.int16(): Type.INT_16, pa.int32(): Type.INT_32, pa.int64(): Type.INT_64, pa.uint8(): Type.UINT_8, pa.uint16(): Type.UINT_16, pa.uint32(): Type.UINT_32, pa.uint64(): Type.UINT_64, pa.float32(): Type.FLOAT_32, pa.float64(): Type.FLOAT_64, pa.date32(): Type.DATE, pa.date64(): Type.DATE}
    if k in named:
        return ColumnSpec(f.name, named[k], label)
    if P.is_string(k) or P.is_large_string(k):
        return ColumnSpec(f.name, Type.STRING, label, is_lob=P.is_large_string(k))
    if P.is_binary(k) or P.is_large_binary(k) or P.is_fixed_size_binary(k):
        return ColumnSpec(f.name, Type.BYTES, label, is_lob=P.is_large_binary(k))
    if P.is_decimal(k):
        return ColumnSpec(f.name, Type.DECIMAL, label, decimal=Decimal(k.precision, k.scale))
    if P.is_timestamp(k):
        return ColumnSpec(f.name, Type.DATETIME_64, label, timestamp=Timestamp({"s": 0, "ms": 3, "us": 6, "ns": 9}[k.unit], k.tz or "Etc/UTC"))
    if P.is_struct(k):
        return ColumnSpec(f.name, Type.NESTED, label, tuple(column_from_arrow(k.field(i)) for i in range(k.num_fields)))
    if P.is_map(k):
        return ColumnSpec(f.name, Type.MAP, label, (column_from_arrow(k.key_field), column_from_arrow(k.item_field)))
    if P.is_list(k) or P.is_large_list(k):
        inner = column_from_arrow(k.value_field)
        if f.nullable or k.value_field.nullable or inner.type in (Type.ARRAY, Type.MAP) or inner.is_repeated:
            return ColumnSpec(f.name, Type.ARRAY, label, (inner,))
        return inner.with_(name=f.name, label=Label.REPEATED)
    raise ValueError(f"no logical type for {k} of `{f.name}`")


def from_arrow(schema, name: str = "table") -> TableSpec:
    return TableSpec(name, tuple(column_from_arrow(f) for f in schema), source="ARROW")


def from_parquet(path: str, name: str = "table") -> TableSpec:
    """The schema of a Parquet file, read from its footer."""
    import pyarrow.parquet

    return from_arrow(pyarrow.parquet.read_schema(path), name)


def to_pandas(t: TableSpec) -> dict[str, typing.Any]:
    """dtype of each column."""
    import pandas as pd

    named = {Type.STRING: pd.StringDtype(), Type.BOOLEAN: pd.BooleanDtype(), Type.FLOAT_32: pd.Float32Dtype(), Type.FLOAT_64: pd.Float64Dtype()}
    named |= {k: getattr(pd, ("UInt" if k in UNSIGNED else "Int") + k.name.rpartition("_")[2] + "Dtype")() for k in (Type.INT_8, Type.INT_16, Type.INT_32, Type.INT_64, *UNSIGNED)}

    def of(c: ColumnSpec):
        if c.is_repeated:
            return "O"
        if c.type is Type.DATETIME_64:
            return pd.DatetimeTZDtype("ns", c.timestamp.timezone if c.timestamp else "Etc/UTC")
        return named.get(c.type, "O")

    return {c.name: of(c) for c in t.columns}


# Dataclasses: annotations are attached with typing.Annotated[type, {...ColumnSpec fields}]


_PYTHON = {int: Type.INT_64, float: Type.FLOAT_64, str: Type.STRING, bytes: Type.BYTES, bool: Type.BOOLEAN, datetime.date: Type.DATE, datetime.datetime: Type.DATETIME_64, decimal.Decimal: Type.DECIMAL}


def column_from_python(name: str, kind: typing.Any) -> ColumnSpec:
    notes: dict = {}
    while typing.get_origin(kind) is typing.Annotated:
        kind, *extra = typing.get_args(kind)
        for x in extra:
            if isinstance(x, dict):
                notes = {**x, **notes}
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType) and type(None) in args:
        inner = column_from_python(name, next(a for a in args if a is not type(None)))
        if inner.is_repeated:
            inner = ColumnSpec(name, Type.ARRAY, Label.OPTIONAL, (inner.with_(name="element", label=Label.REQUIRED),))
        return inner.with_(label=Label.OPTIONAL, **notes)
    if origin in (list, collections.abc.Sequence):
        inner = column_from_python(name, args[0])
        if inner.is_optional or inner.is_repeated or inner.type in (Type.ARRAY, Type.SET, Type.MAP) or notes.pop("array", False):
            return ColumnSpec(name, Type.ARRAY, Label.REQUIRED, (inner.with_(name="element"),)).with_(**notes)
        return inner.with_(label=Label.REPEATED, **notes)
    if origin in (set, frozenset):
        return ColumnSpec(name, Type.SET, Label.REQUIRED, (column_from_python("element", args[0]),)).with_(**notes)
    if origin is dict:
        return ColumnSpec(name, Type.MAP, Label.REQUIRED, (column_from_python("key", args[0]), column_from_python("value", args[1]))).with_(**notes)
    if dataclasses.is_dataclass(kind):
        return ColumnSpec(name, Type.NESTED, Label.REQUIRED, from_dataclass(kind).columns, struct_name=kind.__name__).with_(**notes)
    if kind not in _PYTHON:
        raise ValueError(f"no logical type for {kind} of `{name}`")
    if _PYTHON[kind] is Type.DATETIME_64:
        notes.setdefault("timestamp", Timestamp(6))
    return ColumnSpec(name, _PYTHON[kind]).with_(**notes)


def from_dataclass(cls: type, **table) -> TableSpec:
    """A dataclass as a table; its attribute __table__ may hold table annotations."""
    hints = typing.get_type_hints(cls, include_extras=True)
    notes = {**getattr(cls, "__table__", {}), **table}
    return TableSpec(cls.__name__, tuple(column_from_python(f.name, hints[f.name]) for f in dataclasses.fields(cls)), cls.__module__, source="DATACLASS", **notes)


_PROTO = {1: Type.FLOAT_64, 2: Type.FLOAT_32, 3: Type.INT_64, 4: Type.UINT_64, 5: Type.INT_32, 6: Type.UINT_64, 7: Type.UINT_32, 8: Type.BOOLEAN, 9: Type.STRING, 12: Type.BYTES, 13: Type.UINT_32, 14: Type.INT_32, 15: Type.INT_32, 16: Type.INT_64, 17: Type.INT_32, 18: Type.INT_64}


def from_protobuf(descriptor) -> TableSpec:
    """A message descriptor as a table; fields numbered by wire type."""

    def of(f) -> ColumnSpec:
        label = Label.REPEATED if f.is_repeated else Label.REQUIRED if f.is_required else Label.OPTIONAL
        if f.message_type is not None:
            if f.message_type.GetOptions().map_entry:
                k, v = f.message_type.fields
                return ColumnSpec(f.name, Type.MAP, Label.REQUIRED, (of(k).with_(label=Label.REQUIRED), of(v).with_(label=Label.REQUIRED)))
            if f.message_type.full_name == "google.protobuf.Timestamp":
                return ColumnSpec(f.name, Type.DATETIME_64, label, timestamp=Timestamp(9))
            return ColumnSpec(f.name, Type.NESTED, label, tuple(of(x) for x in f.message_type.fields), struct_name=f.message_type.name)
        return ColumnSpec(f.name, _PROTO[f.type], label)

    return TableSpec(descriptor.name, tuple(of(f) for f in descriptor.fields), descriptor.file.package, source="PROTO")
