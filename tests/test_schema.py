"""Model, bridges, comparison, exporters."""

import dataclasses
import datetime
import decimal
import typing

import pytest
from hypothesis import given
from hypothesis import strategies as st

from flowschema import bridge, compare
from flowschema.compare import Code
from flowschema.export import ansi_ddl, clickhouse_ddl, spark_ddl, to_beam, to_dataclass, to_dbml, to_scala
from flowschema.model import ColumnSpec, Compression, Decimal, Label, Quality, TableSpec, Timestamp, Type, asdict, table_from_dict, validate
from flowschema.sources.clickhouse_ddl import from_clickhouse_ddl

R, O, M = Label.REQUIRED, Label.OPTIONAL, Label.REPEATED


@dataclasses.dataclass
class Inner:
    a: str
    b: typing.Optional[int]


@dataclasses.dataclass
class Outer:
    key: typing.Annotated[str, {"is_id": True}]
    day: datetime.date
    price: typing.Optional[typing.Annotated[decimal.Decimal, {"decimal": Decimal(12, 2)}]]
    many: list[int]
    maybe: list[typing.Optional[int]]
    inner: Inner
    marks: set[str]
    pairs: dict[int, Inner]


def test_dataclass_to_spark_and_back():
    t = bridge.from_dataclass(Outer)
    assert validate(t) == []
    schema = bridge.to_spark(t)
    assert schema["many"].dataType.containsNull is False and schema["maybe"].dataType.containsNull is True
    assert schema["price"].nullable and not schema["key"].nullable
    assert bridge.from_spark(schema).columns == t.columns
    assert table_from_dict(asdict(t)) == t
    assert bridge.from_arrow(bridge.to_arrow(t)).names() == t.names()


leaf = st.sampled_from([k for k in Type if k.value in (*range(1, 12), 13, 14, 15)])


@st.composite
def columns(draw, depth=2):
    name, label = draw(st.from_regex(r"[a-z]{1,5}", fullmatch=True)), draw(st.sampled_from([R, O, M]))
    if depth and draw(st.booleans()):
        kind = draw(st.sampled_from([Type.NESTED, Type.ARRAY, Type.SET, Type.MAP]))
        n = {Type.NESTED: 2, Type.ARRAY: 1, Type.SET: 1, Type.MAP: 2}[kind]
        fields = tuple(draw(columns(depth=depth - 1)).with_(name=f"f{i}", **({"label": R} if i == 0 and kind is Type.MAP else {})) for i in range(n))
        return ColumnSpec(name, kind, label, fields)
    return ColumnSpec(name, draw(leaf), label)


@given(columns())
def test_any_column_survives_spark_and_equals_itself(c):
    t = TableSpec("t", (c,))
    assert bridge.from_spark(bridge.to_spark(t), "t").columns == t.columns
    assert compare.compare(t, t) == []
    assert table_from_dict(asdict(t)) == t


def codes(dest, src):
    return [d.code for d in compare.compare(TableSpec("t", (dest,)), TableSpec("t", (src,)))]


@pytest.mark.parametrize(
    "dest,src,want",
    [
        (ColumnSpec("a", Type.STRING, O), ColumnSpec("a", Type.STRING, R), [Code.LABEL_CONVERTIBLE]),
        (ColumnSpec("a", Type.STRING, R), ColumnSpec("a", Type.STRING, O), [Code.LABEL]),
        (ColumnSpec("a", Type.STRING, M), ColumnSpec("a", Type.STRING, O), [Code.LABEL_CONVERTIBLE]),
        (ColumnSpec("a", Type.INT_64), ColumnSpec("a", Type.INT_32), [Code.TYPES_DIFFERENT_CONVERTIBLE]),
        (ColumnSpec("a", Type.INT_32), ColumnSpec("a", Type.INT_64), [Code.TYPES_INCOMPATIBLE]),
        (ColumnSpec("a", Type.UINT_32), ColumnSpec("a", Type.INT_32), [Code.TYPES_SIGNLOSS_CONVERTIBLE]),
        (ColumnSpec("a", Type.STRING), ColumnSpec("a", Type.INT_32), [Code.TYPES_INCOMPATIBLE]),
        (ColumnSpec("a", Type.DECIMAL, decimal=Decimal(14, 4)), ColumnSpec("a", Type.DECIMAL, decimal=Decimal(12, 2)), [Code.DECIMAL_CONVERTIBLE] * 2),
        (ColumnSpec("a", Type.DECIMAL, decimal=Decimal(12, 2)), ColumnSpec("a", Type.DECIMAL, decimal=Decimal(12, 4)), [Code.DECIMAL]),
        (ColumnSpec("a", Type.DATETIME_64, timestamp=Timestamp(3)), ColumnSpec("a", Type.DATETIME_64, timestamp=Timestamp(6)), [Code.DATETIME]),
        (ColumnSpec("a", Type.ARRAY, R, (ColumnSpec("element", Type.STRING),)), ColumnSpec("a", Type.SET, R, (ColumnSpec("element", Type.STRING),)), [Code.ARRAY_SET_MISMATCH]),
        (ColumnSpec("a", Type.ARRAY, R, (ColumnSpec("element", Type.STRING),)), ColumnSpec("a", Type.STRING, M), [Code.REPEATED_STRUCT_MISMATCH]),
        (ColumnSpec("a", Type.STRING), ColumnSpec("b", Type.STRING), [Code.NOT_FOUND_DEST, Code.NOT_FOUND_SRC]),
    ],
)
def test_diff_codes(dest, src, want):
    assert codes(dest, src) == want


@pytest.mark.parametrize(
    "column,problem",
    [
        (ColumnSpec("a", Type.DECIMAL), "decimal annotation missing"),
        (ColumnSpec("a", Type.DECIMAL, decimal=Decimal(80)), "out of range"),
        (ColumnSpec("a", Type.DECIMAL, decimal=Decimal(4, 5)), "exceeds"),
        (ColumnSpec("a", Type.STRING, decimal=Decimal(4)), "is none"),
        (ColumnSpec("a", Type.DATETIME_64, timestamp=Timestamp(5)), "0, 3, 6, 9"),
        (ColumnSpec("a", Type.INT_8, timestamp=Timestamp(3)), "is none"),
        (ColumnSpec("a", Type.INT_8, low_cardinality=True), "no string"),
        (ColumnSpec("a", Type.INT_8, delta=3), "1, 2, 4, 8"),
        (ColumnSpec("a", Type.STRING, delta=4), "no differences"),
        (ColumnSpec("a", Type.STRING, compression=Compression("LZ4", 3)), "without ZSTD"),
        (ColumnSpec("a", Type.STRING, Label.UNDEFINED), "undefined label"),
    ],
)
def test_validation(column, problem):
    assert problem in "; ".join(validate(TableSpec("t", (column,))))


def test_table_validation():
    c = ColumnSpec("a", Type.STRING, O)
    assert "isn't required" in validate(TableSpec("t", (c,), order_by=("a",)))[0]
    assert "doesn't have" in validate(TableSpec("t", (c,), partition_by=("b",)))[0]
    assert "doesn't go" in validate(TableSpec("t", (c.with_(label=R),), engine="LOG", order_by=("a",)))[0]
    assert validate(TableSpec("t", (c,), partition_by=("toYYYYMM(a)",))) == []


FULL = TableSpec(
    "full",
    (
        ColumnSpec("id", Type.INT_64, is_id=True, delta=4, compression=Compression("ZSTD", 7)),
        ColumnSpec("d", Type.DECIMAL, O, decimal=Decimal(12, 2), comment="it's"),
        ColumnSpec("tags", Type.STRING, M),
        ColumnSpec("n", Type.NESTED, fields=(ColumnSpec("a", Type.UINT_8),), nested_type="TUPLE", struct_name="N"),
        ColumnSpec("ts", Type.DATETIME_64, timestamp=Timestamp(3)),
        ColumnSpec("s", Type.STRING, low_cardinality=True, quality=Quality(values=("a",))),
    ),
    engine="MERGE_TREE", order_by=("id",), index_granularity=8192,
)


def test_exports():
    ddl = clickhouse_ddl(FULL)
    assert clickhouse_ddl(from_clickhouse_ddl(ddl)) == ddl
    assert "s LowCardinality(String)" in ddl and "CODEC(Delta(4), ZSTD(7))" in ddl
    assert "`d` decimal(12,2)" in spark_ddl(FULL) and "PRIMARY KEY (id)" in ansi_ddl(FULL)
    assert "case class Full(" in to_scala(FULL) and "d: Option[Decimal]" in to_scala(FULL)
    assert 'id "INT64" [not null, primary key]' in to_dbml(FULL)
    assert to_beam(FULL) == to_beam(FULL) and len(to_beam(FULL)["fields"]) == 6
    space: dict = {}
    exec(compile(to_dataclass(FULL), "generated", "exec"), space)
    assert bridge.from_dataclass(space["Full"]).columns == FULL.columns


def test_coerce(spark):
    df = spark.sql("SELECT 1L AS a, DATE '1970-01-03' AS d, 'x' AS s, 300 AS big")
    src = TableSpec("s", (ColumnSpec("d", Type.DATE), ColumnSpec("s", Type.STRING)))
    dest = TableSpec("t", (ColumnSpec("d", Type.INT_32), ColumnSpec("s", Type.STRING, M), ColumnSpec("big", Type.INT_8), ColumnSpec("new", Type.FLOAT_64, O)))
    assert compare.coerce(df, dest, src).first().asDict() == {"d": 2, "s": ["x"], "big": None, "new": None}
