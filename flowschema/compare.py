"""Differences between two tables when the data of one are read as the other, and the casts that bridge them."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridge import _element, loose
from .model import INTEGERS, UNSIGNED, ColumnSpec, Label, TableSpec, Type


class Code(enum.Enum):
    NOT_FOUND_DEST = enum.auto()
    NOT_FOUND_SRC = enum.auto()
    LABEL = enum.auto()
    LABEL_CONVERTIBLE = enum.auto()
    DECIMAL = enum.auto()
    DECIMAL_CONVERTIBLE = enum.auto()
    DATETIME = enum.auto()
    NAMES = enum.auto()
    ARRAY_SET_MISMATCH = enum.auto()
    REPEATED_STRUCT_MISMATCH = enum.auto()
    TYPES_INCOMPATIBLE = enum.auto()
    TYPES_DIFFERENT_CONVERTIBLE = enum.auto()
    TYPES_SIGNLOSS_CONVERTIBLE = enum.auto()
    TABLE_NAMES = enum.auto()


_SHAPE = {Code.NAMES, Code.TABLE_NAMES, Code.ARRAY_SET_MISMATCH, Code.REPEATED_STRUCT_MISMATCH}
_FINE = _SHAPE | {Code.NOT_FOUND_SRC, Code.LABEL_CONVERTIBLE, Code.DECIMAL_CONVERTIBLE, Code.TYPES_DIFFERENT_CONVERTIBLE, Code.TYPES_SIGNLOSS_CONVERTIBLE}


@dataclass(frozen=True)
class Diff:
    code: Code
    column: str | None
    text: str

    @property
    def convertible(self) -> bool:
        return self.code in _FINE

    @property
    def shape_only(self) -> bool:
        return self.code in _SHAPE


#: destination: sources that widen into it
WIDENING = {
    Type.INT_8: {Type.BOOLEAN}, Type.INT_16: {Type.BOOLEAN, Type.INT_8, Type.UINT_8}, Type.INT_32: {Type.BOOLEAN, Type.INT_8, Type.INT_16, Type.UINT_8, Type.UINT_16, Type.DATE},
    Type.INT_64: {Type.BOOLEAN, Type.INT_8, Type.INT_16, Type.INT_32, Type.UINT_8, Type.UINT_16, Type.UINT_32, Type.DATE, Type.DATETIME_64}, Type.UINT_8: {Type.BOOLEAN},
    Type.UINT_16: {Type.BOOLEAN, Type.UINT_8}, Type.UINT_32: {Type.BOOLEAN, Type.UINT_8, Type.UINT_16}, Type.UINT_64: {Type.BOOLEAN, Type.UINT_8, Type.UINT_16, Type.UINT_32}, Type.FLOAT_64: {Type.FLOAT_32},
}
_LISTS = (Type.ARRAY, Type.SET)


def compare_columns(dest: ColumnSpec, src: ColumnSpec, path: str = "", labels: bool = True) -> list[Diff]:
    """Differences when values of src are read as dest."""
    at, out = path or dest.name, []
    if dest.name != src.name and labels:
        out.append(Diff(Code.NAMES, at, f"{src.name} is read as {dest.name}"))
    if dest.type is not src.type:
        if {dest.type, src.type} == {*_LISTS}:
            out.append(Diff(Code.ARRAY_SET_MISMATCH, at, f"{src.type.name} is read as {dest.type.name}"))
            return out + compare_columns(dest.fields[0], src.fields[0], f"{at}.element", False) + _attributes(dest, src, at, labels)
        for one, two in ((dest, src), (src, dest)):
            if one.type in _LISTS and two.is_repeated and two.type not in (*_LISTS, Type.MAP):
                out.append(Diff(Code.REPEATED_STRUCT_MISMATCH, at, f"{'repeated' if src is two else src.type.name} is read as {'repeated' if dest is two else dest.type.name}"))
                pair = (dest.fields[0], src) if one is dest else (dest, src.fields[0])
                return out + compare_columns(*pair, f"{at}.element", False)
        same_width = INTEGERS.get(dest.type, UNSIGNED.get(dest.type)) == INTEGERS.get(src.type, UNSIGNED.get(src.type)) is not None
        if same_width:
            out.append(Diff(Code.TYPES_SIGNLOSS_CONVERTIBLE, at, f"{src.type.name} is read as {dest.type.name}, losing its sign or range"))
        elif src.type in WIDENING.get(dest.type, ()):
            out.append(Diff(Code.TYPES_DIFFERENT_CONVERTIBLE, at, f"{src.type.name} widens to {dest.type.name}"))
        else:
            out.append(Diff(Code.TYPES_INCOMPATIBLE, at, f"{src.type.name} can't be read as {dest.type.name}"))
        return out + _attributes(dest, src, at, labels)
    if dest.type is Type.NESTED:
        out += _fields(dest.fields, src.fields, at + ".")
    elif dest.type in (*_LISTS, Type.MAP):
        for word, d, s in zip(("element",) if dest.type in _LISTS else ("key", "value"), dest.fields, src.fields):
            out += compare_columns(d.with_(name=word), s.with_(name=word), f"{at}.{word}")
    return out + _attributes(dest, src, at, labels)


def _attributes(dest: ColumnSpec, src: ColumnSpec, at: str, labels: bool) -> list[Diff]:
    out = []
    if labels and dest.label is not src.label:
        fine = dest.is_repeated or (dest.is_optional and src.label is Label.REQUIRED)
        out.append(Diff(Code.LABEL_CONVERTIBLE if fine else Code.LABEL, at, f"{src.label.name} is read as {dest.label.name}"))
    if dest.decimal and src.decimal:
        for word in ("precision", "scale"):
            d, s = getattr(dest.decimal, word), getattr(src.decimal, word)
            if d != s:
                out.append(Diff(Code.DECIMAL_CONVERTIBLE if d > s else Code.DECIMAL, at, f"{word} {s} is read as {d}"))
    if dest.timestamp and src.timestamp:
        for word in ("precision", "timezone"):
            d, s = getattr(dest.timestamp, word), getattr(src.timestamp, word)
            if d != s:
                out.append(Diff(Code.DATETIME, at, f"{word} {s} is read as {d}"))
    return out


def _fields(dest: tuple[ColumnSpec, ...], src: tuple[ColumnSpec, ...], prefix: str = "", only: set[str] | None = None) -> list[Diff]:
    d, s = ({c.name: c for c in x if only is None or c.name in only} for x in (dest, src))
    out = [Diff(Code.NOT_FOUND_DEST, prefix + n, "the destination lacks it") for n in s if n not in d]
    out += [Diff(Code.NOT_FOUND_SRC, prefix + n, "the source lacks it") for n in d if n not in s]
    for n, c in d.items():
        if n in s:
            out += compare_columns(c, s[n], prefix + n)
    return out


def compare(dest: TableSpec, src: TableSpec, columns: list[str] | None = None) -> list[Diff]:
    """Differences when rows of src are read as dest: names first, then what is missing, then columns in dest's order."""
    out = []
    if dest.name != src.name:
        out.append(Diff(Code.TABLE_NAMES, None, f"{src.name} is read as {dest.name}"))
    return out + _fields(dest.columns, src.columns, "", set(columns) if columns is not None else None)


def diff_frame(spark: SparkSession, diffs: list[Diff]) -> DataFrame:
    return spark.createDataFrame([(d.code.name, d.column, d.text, d.convertible) for d in diffs], "code string, column string, description string, convertible boolean")


def _cast(value: Column, dest: ColumnSpec, src: ColumnSpec | None, strict: bool) -> Column:
    kind = loose(_element(dest))
    if src is not None and src.type is Type.DATE and dest.type in INTEGERS:
        return F.datediff(value, F.lit("1970-01-01").cast("date")).cast(kind)
    if src is not None and src.type is Type.DATETIME_64 and dest.type in INTEGERS:
        return F.unix_micros(value.cast("timestamp")).cast(kind)
    if src is not None and not src.is_repeated and src.type not in _LISTS and dest.is_repeated:
        return F.array_compact(F.array(_cast(value, dest.with_(label=Label.REQUIRED), src, strict)))
    out = value.cast(kind) if strict else value.try_cast(kind)
    return F.array_distinct(out) if dest.type is Type.SET else out


def coerce(df: DataFrame, dest: TableSpec, src: TableSpec | None = None, strict: bool = False) -> DataFrame:
    """df as dest: its columns in order, cast; missing ones are null, others left out. One projection, no shuffle.

    Without strict, values that don't fit become null. Dates and timestamps read as integers count days and
    microseconds since 1970; a single value read as a repeated column is a list of it."""
    known = {c.name: c for c in src.columns} if src else {}
    out = []
    for c in dest.columns:
        if c.name in df.columns:
            out.append(_cast(F.col(f"`{c.name}`"), c, known.get(c.name), strict).alias(c.name))
        else:
            out.append(F.lit(None).cast(_element(c)).alias(c.name))
    return df.select(*out)
