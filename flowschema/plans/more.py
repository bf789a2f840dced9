"""Queries of statements with effects, sinks, bridges, exporters, validation and generators, with the same results in SQL."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import pickle
import typing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge, compare, quality
from ..export import ansi_ddl, clickhouse_ddl, spark_ddl, to_beam, to_dataclass, to_dbml, to_scala
from ..lineage import endpoints, lineage, to_dot
from ..lineage.endpoints import schema_hints
from ..model import ColumnSpec, Compression, Decimal, Label, Quality, TableSpec, Timestamp, Type, validate
from ..sources.clickhouse_ddl import from_clickhouse_ddl
from ..sources.scratch import scratch
from ..sources.sinks import Writer, write_shards
from ..sources.tables import register
from ..sql import parse, to_sql
from ..sql.lower import run
from ..synth import TableGenerator
from .catalogue import QUERIES as TEXTS

R, O, M = Label.REQUIRED, Label.OPTIONAL, Label.REPEATED


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _pairs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(str(a), str(b)) for a, b in rows], "name string, value string")


def _values(rows: list[tuple]) -> str:
    quoted = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t(name, value)"


# Statements with effects


def stmt_stored_as(spark: SparkSession, folder: str) -> DataFrame:
    """Hive storage clauses: a partitioned, bucketless table in Parquet, one in delimited text."""
    register(spark, folder, ["nation"])
    at = scratch(spark)
    text = f"""DROP TABLE IF EXISTS fs_stored; DROP TABLE IF EXISTS fs_text;
    CREATE TABLE fs_stored (k INT, name STRING) PARTITIONED BY (region INT) STORED AS PARQUET LOCATION '{at}/a';
    INSERT INTO TABLE fs_stored PARTITION (region) SELECT n_nationkey, n_name, n_regionkey FROM nation;
    CREATE TABLE fs_text (k INT, name STRING) ROW FORMAT DELIMITED FIELDS TERMINATED BY '|' STORED AS TEXTFILE LOCATION '{at}/b';
    INSERT INTO fs_text SELECT k, name FROM fs_stored WHERE region < 3;
    SELECT s.k, s.name, s.region, t.k IS NOT NULL AS in_text FROM fs_stored s LEFT JOIN fs_text t ON s.k = t.k"""
    return run(spark, text)


def stmt_view_using(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, f"CREATE OR REPLACE TEMPORARY VIEW fs_regions USING parquet OPTIONS (path '{folder}/region.parquet'); SELECT r_regionkey, r_name FROM fs_regions")


def stmt_create_insert_drop(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, ["supplier"])
    at = scratch(spark)
    text = f"""DROP TABLE IF EXISTS fs_made; CREATE TABLE fs_made USING parquet LOCATION '{at}' AS SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 10;
    INSERT INTO fs_made SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 20; CREATE OR REPLACE TEMPORARY VIEW fs_view AS SELECT s_nationkey, count(*) AS n FROM fs_made GROUP BY s_nationkey;
    DROP VIEW IF EXISTS fs_none; SELECT * FROM fs_view"""
    return run(spark, text)


def stmt_database(spark: SparkSession, folder: str) -> DataFrame:
    text = f"CREATE DATABASE IF NOT EXISTS fs_db COMMENT 'x' LOCATION '{scratch(spark)}'; USE fs_db; SELECT current_database() AS now"
    out = run(spark, text).collect()
    run(spark, "USE default; DROP DATABASE IF EXISTS fs_db CASCADE")
    return spark.createDataFrame(out, "now string")


def ch_materialized_to(spark: SparkSession, folder: str) -> DataFrame:
    """MATERIALIZED VIEW v TO t, INSERT ... SELECT and INTO OUTFILE, which is read back."""
    register(spark, folder, ["nation"])
    at = scratch(spark)
    run(spark, f"DROP TABLE IF EXISTS fs_target; CREATE TABLE fs_target (k INT, n BIGINT) USING parquet LOCATION '{at}/t'")
    run(spark, "CREATE MATERIALIZED VIEW fs_mv TO fs_target AS SELECT n_regionkey AS k, count() AS n FROM nation GROUP BY n_regionkey", "clickhouse")
    run(spark, "INSERT INTO fs_target SELECT 99 AS k, count() AS n FROM nation", "clickhouse")
    run(spark, f"SELECT k, n FROM fs_target INTO OUTFILE '{at}/out' FORMAT JSONEachRow", "clickhouse")
    return spark.read.schema("k int, n long").json(f"{at}/out")


def sql_template(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, ["region"])
    return run(spark, "SELECT ${col} AS x FROM ${table} WHERE r_regionkey > 1", variables={"col": "r_name", "table": "region"})


def ch_file_source(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, f"SELECT r_name FROM file('{folder}/region.parquet', Parquet) WHERE r_regionkey < 3", "clickhouse")


def sql_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the catalogue printed and parsed again says the same."""
    same = [(name, to_sql(parse(to_sql(parse(t, d)[0]), d)[0]) == to_sql(parse(t, d)[0])) for name, (d, t, _) in TEXTS.items()]
    return spark.createDataFrame([(sum(ok for _, ok in same), [n for n, ok in same if not ok])], "same long, others array<string>").selectExpr("same", "size(others) AS others")


# Sinks


def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Two shards with a separator, a null text, formatted floats: the lines are those written."""
    rows = _read(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    at = scratch(spark)
    write_shards(rows, Writer("csv", {"sep": ";", "na_rep": "NULL", "float_format": "%.3f"}), at, 2, "part")
    return spark.read.option("wholetext", False).text(at, recursiveFileLookup=True).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def sink_json_document(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark)
    rows = _read(spark, folder, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("name"))
    Writer("json", {"document": True}).write(rows.coalesce(1), at)
    return spark.read.option("multiLine", True).schema("n_nationkey int, name string").json(at)


def sink_pickle(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark)
    write_shards(_read(spark, folder, "region"), Writer("pickle", {"protocol": 4}), at, 2)
    raw = spark.read.format("binaryFile").load(at).select("content").collect()  # the five rows of region
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for x in raw for r in pickle.loads(bytes(x.content))], "r_regionkey int, r_name string")


def sink_parquet(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark)
    rows = _read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("decimal(20,0)").alias("wide"), "o_orderdate")
    write_shards(rows, Writer("parquet", {"compression": "zstd", "use_dictionary": False, "row_group_size": 1 << 20, "version": "2.6", "no_uint": True}), at, 3)
    out = spark.read.parquet(at)
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("shards"), (F.max("n") - F.min("n") <= 3).alias("even")).withColumn("kind", F.lit(dict(out.dtypes)["wide"]))


def sink_table(spark: SparkSession, folder: str) -> DataFrame:
    run(spark, f"DROP TABLE IF EXISTS fs_sink; CREATE TABLE fs_sink (r_regionkey INT, r_name STRING) USING parquet LOCATION '{scratch(spark)}'")
    Writer("table").write(_read(spark, folder, "region"), "fs_sink", "append")
    return spark.table("fs_sink").select("r_regionkey", "r_name")


# Models


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
    pairs: dict[int, Inner]


FULL = TableSpec(
    "full",
    (
        ColumnSpec("id", Type.INT_64, is_id=True, delta=4, compression=Compression("ZSTD", 7)), ColumnSpec("d", Type.DECIMAL, O, decimal=Decimal(12, 2)), ColumnSpec("tags", Type.STRING, M),
        ColumnSpec("n", Type.NESTED, fields=(ColumnSpec("a", Type.UINT_8),), nested_type="TUPLE", struct_name="N"), ColumnSpec("ts", Type.DATETIME_64, timestamp=Timestamp(3)), ColumnSpec("s", Type.STRING, low_cardinality=True),
    ),
    engine="MERGE_TREE", order_by=("id",), index_granularity=8192,
)


def model_from_dataclass(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, [(c.name, f"{c.type.name} {c.label.name} {len(c.fields)}") for c in bridge.from_dataclass(Outer).columns])


def model_to_spark(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, [(f.name, f"{f.dataType.simpleString()} {f.nullable}") for f in bridge.to_spark(bridge.from_dataclass(Outer))])


def model_to_arrow(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, [(f.name, f"{f.type} {f.nullable}") for f in bridge.to_arrow(FULL)])


def model_from_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, [(c.name, c.type.name) for c in bridge.from_parquet(f"{folder}/part.parquet").columns])


def model_to_pandas(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, [(n, t if isinstance(t, str) else getattr(t, "__name__", str(t))) for n, t in bridge.to_pandas(TableSpec("t", FULL.columns[:1] + FULL.columns[5:])).items()])


def model_paths(spark: SparkSession, folder: str) -> DataFrame:
    t = bridge.from_dataclass(Outer)
    return _pairs(spark, [("pick", t.pick(["day", "key"]).names()), ("find", t.column("inner.b").type.name), ("ids", t.ids())])


def export_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """The ClickHouse DDL of a model, imported again and printed again, is itself; the parts that carry meaning are there."""
    ddl = clickhouse_ddl(FULL)
    again = from_clickhouse_ddl(ddl)
    parts = ["LowCardinality(String)", "CODEC(Delta(4), ZSTD(7))", "Nullable(Decimal", "Array(String)", "ENGINE = MergeTree", "ORDER BY"]
    return _pairs(spark, [("again", clickhouse_ddl(again) == ddl), ("engine", again.engine), ("order", again.order_by), ("codec", again.column("id").compression.codec), *((p, p in ddl) for p in parts)])


def export_spark_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """The DDL makes a table whose columns are those of the model."""
    run(spark, "DROP TABLE IF EXISTS fs_full")
    spark.sql(spark_ddl(FULL, "fs_full") + f" LOCATION '{scratch(spark)}'")
    return _pairs(spark, [(f.name, f.dataType.simpleString()) for f in spark.table("fs_full").schema])


def export_code(spark: SparkSession, folder: str) -> DataFrame:
    """The generated dataclass gives the model back; Scala, DBML, ANSI and Beam have its columns."""
    space: dict = {}
    exec(compile(to_dataclass(FULL), "generated", "exec", dont_inherit=True), space)
    beam = to_beam(FULL)
    return _pairs(spark, [
        ("dataclass", bridge.from_dataclass(space["Full"]).columns == FULL.columns), ("scala", all(x in to_scala(FULL) for x in ("case class Full(", "d: Option[Decimal]", "id: Long"))),
        ("dbml", 'id "INT64" [not null, primary key]' in to_dbml(FULL)), ("ansi", "PRIMARY KEY (id)" in ansi_ddl(FULL)), ("beam", [f["name"] for f in beam["fields"]]),
    ])


_BAD = [
    ("decimal missing", ColumnSpec("a", Type.DECIMAL), "decimal annotation missing"), ("decimal precision", ColumnSpec("a", Type.DECIMAL, decimal=Decimal(80)), "out of range"),
    ("decimal scale", ColumnSpec("a", Type.DECIMAL, decimal=Decimal(4, 5)), "exceeds"), ("decimal type", ColumnSpec("a", Type.STRING, decimal=Decimal(4)), "is none"),
    ("timestamp precision", ColumnSpec("a", Type.DATETIME_64, timestamp=Timestamp(5)), "0, 3, 6, 9"), ("timestamp type", ColumnSpec("a", Type.INT_8, timestamp=Timestamp(3)), "is none"),
    ("low cardinality", ColumnSpec("a", Type.INT_8, low_cardinality=True), "no string"), ("delta value", ColumnSpec("a", Type.INT_8, delta=3), "1, 2, 4, 8"), ("delta type", ColumnSpec("a", Type.STRING, delta=4), "no differences"),
    ("level", ColumnSpec("a", Type.STRING, compression=Compression("LZ4", 3)), "without ZSTD"), ("label", ColumnSpec("a", Type.STRING, Label.UNDEFINED), "undefined label"), ("fine", ColumnSpec("a", Type.STRING), None),
]


def model_validate_columns(spark: SparkSession, folder: str) -> DataFrame:
    found = [(name, validate(TableSpec("t", (c,))), part) for name, c, part in _BAD]
    return _pairs(spark, [(name, (len(x) == 1 and part in x[0]) if part else not x) for name, x, part in found])


def model_validate_tables(spark: SparkSession, folder: str) -> DataFrame:
    c = ColumnSpec("a", Type.STRING, O)
    tables = [("optional", TableSpec("t", (c,), order_by=("a",))), ("unknown", TableSpec("t", (c,), partition_by=("b",))), ("engine", TableSpec("t", (c.with_(label=R),), engine="LOG", order_by=("a",))), ("granularity", TableSpec("t", (c,), engine="LOG", index_granularity=10)), ("function", TableSpec("t", (c,), partition_by=("toYYYYMM(a)",))), ("twice", TableSpec("t", (c, c)))]
    return _pairs(spark, [(n, len(validate(t))) for n, t in tables])


def compare_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the whole-number and date types convert to which without loss."""
    kinds = [Type.INT_8, Type.INT_16, Type.INT_32, Type.INT_64, Type.UINT_8, Type.UINT_32]
    rows = []
    for d in kinds:
        for s in kinds:
            diffs = compare.compare(TableSpec("t", (ColumnSpec("a", d),)), TableSpec("t", (ColumnSpec("a", s),)))
            rows.append((f"{s.name} to {d.name}", all(x.convertible for x in diffs)))
    return _pairs(spark, rows)


# Quality


def dq_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The remaining expectations: place and type of columns, dates in text, a compound key, an ignored column."""
    rows = _read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("2020-0"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") < 5, "-11").otherwise("-xx")).alias("day"), "l_quantity")
    t = TableSpec("l", (ColumnSpec("l_orderkey", Type.INT_64, is_id=True), ColumnSpec("l_linenumber", Type.INT_32, is_id=True), ColumnSpec("day", Type.STRING, quality=Quality(format="date")), ColumnSpec("l_quantity", Type.INT_64, quality=Quality(ignored=True)), ColumnSpec("gone", Type.STRING, O)))
    return quality.evaluate(rows, [e for e in quality.expectations(t) if e.kind in ("exists", "of_type", "date_parseable", "unique")])


# Lineage


_TEXT = "WITH c AS (SELECT x, y FROM src) SELECT c.x AS z, (SELECT max(q) FROM other) AS m FROM c WHERE y > 1"


def lineage_reach(spark: SparkSession, folder: str) -> DataFrame:
    g = lineage(_TEXT)
    src = next(n.id for n in g.nodes if n.name == "src")
    above = {n.kind for n in g.nodes if n.id in g.reach({src}, down=False)}
    dot = to_dot(g)
    return _pairs(spark, [("inputs", g.inputs()), ("query above src", "query" in above), ("dot nodes", all(x in dot for x in ("digraph", "src", "other"))), ("less detail", to_dot(g, 0).count("->") <= dot.count("->"))])


def lineage_hints(spark: SparkSession, folder: str) -> DataFrame:
    e = endpoints("CREATE TABLE big AS SELECT * FROM a JOIN b USING (k); INSERT INTO fin SELECT * FROM big")
    hints = schema_hints("--@Schema: a TableA\n -- @Output: Fin\nSELECT 1")
    return _pairs(spark, [("inputs", e.inputs), ("outputs", e.outputs), ("a", hints["a"]), ("output", hints[""])])


# Generators: each property of the values, over all rows


def _generated(spark: SparkSession, rows: int, /, **specs: tuple[Type, typing.Any]) -> DataFrame:
    columns = tuple(t if isinstance(t, ColumnSpec) else ColumnSpec(name, t) for name, (t, _) in specs.items())
    return TableGenerator(TableSpec("g", columns), rows, {k: v for k, (_, v) in specs.items() if v is not None}).frame(spark, 3)


def _true(df: DataFrame, **checks: str) -> DataFrame:
    return df.select(*(F.expr(x).alias(k) for k, x in checks.items()))


def synth_numbers(spark: SparkSession, folder: str) -> DataFrame:
    g = _generated(spark, 20000, u=(Type.FLOAT_64, ("uniform", 2.0, 5.0)), n=(Type.FLOAT_64, ("normal", 10.0, 2.0)), e=(Type.FLOAT_64, ("exp", 3.0)), g=(Type.INT_64, ("geom", 0.25)), p=(Type.FLOAT_64, ("pareto", 3.0)), i=(Type.INT_64, ("int", 5, 9)), v=(Type.INT_64, ("val", 7)))
    return _true(g, uniform="min(u) >= 2 AND max(u) < 5 AND abs(avg(u) - 3.5) < 0.05", normal="abs(avg(n) - 10) < 0.1 AND abs(stddev(n) - 2) < 0.1", exp="min(e) >= 0 AND abs(avg(e) - 3) < 0.15", geom="min(g) = 1 AND abs(avg(g) - 4) < 0.2", pareto="min(p) >= 0 AND abs(avg(p) - 0.5) < 0.1", int="min(i) = 5 AND max(i) = 8 AND count(DISTINCT i) = 4", val="min(v) = 7 AND max(v) = 7")


def synth_conversions(spark: SparkSession, folder: str) -> DataFrame:
    g = _generated(spark, 100, i=(Type.INT_64, ("toint", ("val", "12"))), d=(Type.DATE, ("todate", ("val", "2021-03-04"))), t=(Type.DATETIME_64, ("todatetime", ("val", "2021-03-04 05:06:07"))), b=(Type.BOOLEAN, ("tobool", ("int", 0, 2))), s=(Type.STRING, ("tostring", ("val", 5))), y=(Type.BYTES, ("tobytes", ("val", "ab"))))
    return _true(g, toint="min(i) = 12", todate="min(d) = DATE '2021-03-04'", todatetime="min(t) = TIMESTAMP '2021-03-04 05:06:07'", tobool="count(DISTINCT b) = 2", tostring="min(s) = '5'", tobytes="min(decode(y, 'UTF-8')) = 'ab'")


def synth_texts(spark: SparkSession, folder: str) -> DataFrame:
    g = _generated(spark, 5000, s=(Type.STRING, ("str", 6, "xyz")), c=(Type.STRING, ("choice", ["a", "b"], [0.9, 0.1])), f=(Type.STRING, ("format", "{}-{:03d}", "k", ("inc", 1))), j=(Type.STRING, ("concat", ["p", ("int", 0, 3)], "/")), n=(Type.STRING, ("faker", "name")))
    return _true(g, str="min(s RLIKE '^[xyz]{6}$') AND count(DISTINCT s) > 600", choice="abs(avg(if(c = 'a', 1, 0)) - 0.9) < 0.03 AND count(DISTINCT c) = 2", format="min(f) = 'k-001' AND count(DISTINCT f) = 5000", concat="count(DISTINCT j) = 3 AND min(j) = 'p/0'", faker="min(length(n)) > 1 AND count(DISTINCT n) > 20")


def synth_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Defaults by type, five percent of nulls in optional columns, widths, ids, repeated columns."""
    c = lambda n, t, l=R, **k: ColumnSpec(n, t, l, **k)
    t = TableSpec("d", (c("k", Type.INT_64, is_id=True), c("ks", Type.STRING, is_id=True), c("o", Type.INT_32, O), c("w", Type.STRING, width=4), c("m", Type.INT_16, M), c("day", Type.DATE), c("at", Type.DATETIME_64), c("flag", Type.BOOLEAN), c("x", Type.FLOAT_64), c("price", Type.DECIMAL, decimal=Decimal(6, 2)), c("n", Type.NESTED, fields=(c("a", Type.INT_8), c("b", Type.STRING, O)))))
    g = TableGenerator(t, 20000, {"n.b": ("val", "set"), "flag": ("val", True), "x|nothing": ("val", 0.5)}).frame(spark, 4)
    return _true(g, ids="min(k) = 1 AND count(DISTINCT k) = 20000 AND min(ks) = 'ks_1'", optional="abs(avg(if(o IS NULL, 1, 0)) - 0.05) < 0.01", width="max(length(w)) = 4", repeated="min(size(m)) >= 2 AND max(size(m)) <= 5", day="min(day) >= DATE '2010-01-01' AND max(day) < DATE '2020-01-02'", stamp="count(at) = 20000", price="max(price) < 10000 AND count(DISTINCT price) > 1000", nested="min(n.b) = 'set' AND max(n.a) <= 126", path="min(flag)", pattern="min(x) = 0.5 AND max(x) = 0.5")


def synth_collections(spark: SparkSession, folder: str) -> DataFrame:
    arr = lambda n, kind: ColumnSpec(n, kind, R, (ColumnSpec("element", Type.INT_64),))
    t = TableSpec("c", (arr("a", Type.ARRAY), arr("s", Type.SET), ColumnSpec("m", Type.MAP, R, (ColumnSpec("key", Type.STRING), ColumnSpec("value", Type.INT_64)))))
    g = TableGenerator(t, 3000, {"a": ("array", ("int", 0, 10), ("int", 1, 4)), "s": ("set", ("int", 0, 5), 4), "m": ("dict", ("format", "k{}", ("int", 0, 100)), ("int", 0, 3), 3)}).frame(spark, 2)
    return _true(g, array="min(size(a)) = 1 AND max(size(a)) = 3 AND max(array_max(a)) = 9", set="max(size(s)) <= 4 AND max(size(s) - size(array_distinct(s))) = 0", dict="max(size(m)) <= 3 AND min(size(m)) >= 1")


def synth_same_for_any_partitions(spark: SparkSession, folder: str) -> DataFrame:
    make = lambda parts: TableGenerator(TableSpec("g", (ColumnSpec("k", Type.INT_64, is_id=True), ColumnSpec("s", Type.STRING, O))), 3000).frame(spark, parts)
    return make(2).exceptAll(make(7)).agg(F.count(F.lit(1)).alias("different"))


QUERIES = {
    f.__name__: f
    for f in (
        stmt_stored_as, stmt_view_using, stmt_create_insert_drop, stmt_database, ch_materialized_to, sql_template, ch_file_source, sql_round_trip, sink_csv, sink_json_document, sink_pickle, sink_parquet, sink_table,
        model_from_dataclass, model_to_spark, model_to_arrow, model_from_parquet, model_to_pandas, model_paths, export_ddl, export_spark_ddl, export_code, model_validate_columns, model_validate_tables, compare_lattice,
        dq_kinds, lineage_reach, lineage_hints, synth_numbers, synth_conversions, synth_texts, synth_defaults, synth_collections, synth_same_for_any_partitions,
    )
}


def _all_true(*names: str) -> str:
    return "SELECT " + ", ".join(f"true AS {n}" for n in names)


ORACLE_SQL = {
    "stmt_stored_as": "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, n_regionkey < 3 AS in_text FROM nation",
    "stmt_view_using": "SELECT r_regionkey, r_name FROM region",
    "stmt_create_insert_drop": "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey < 10 OR s_nationkey = 20 GROUP BY s_nationkey",
    "stmt_database": "SELECT 'fs_db' AS now",
    "ch_materialized_to": "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT 99, count(*) FROM nation",
    "sql_template": "SELECT r_name AS x FROM region WHERE r_regionkey > 1",
    "ch_file_source": "SELECT r_name FROM region WHERE r_regionkey < 3",
    "sql_round_trip": f"SELECT {len(TEXTS)}::BIGINT AS same, 0::INT AS others",
    "sink_csv": "SELECT c_custkey || ';' || CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE printf('%.3f', c_acctbal) END AS value, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'c_custkey;bal', 2",
    "sink_json_document": "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS name FROM nation",
    "sink_pickle": "SELECT r_regionkey, r_name FROM region",
    "sink_parquet": "SELECT count(*)::BIGINT AS rows, 3::BIGINT AS shards, true AS even, 'bigint' AS kind FROM orders",
    "sink_table": "SELECT r_regionkey, r_name FROM region",
    "model_from_dataclass": _values([("key", "STRING REQUIRED 0"), ("day", "DATE REQUIRED 0"), ("price", "DECIMAL OPTIONAL 0"), ("many", "INT_64 REPEATED 0"), ("maybe", "ARRAY REQUIRED 1"), ("inner", "NESTED REQUIRED 2"), ("pairs", "MAP REQUIRED 2")]),
    "model_to_spark": _values([("key", "string False"), ("day", "date False"), ("price", "decimal(12,2) True"), ("many", "array<bigint> False"), ("maybe", "array<bigint> False"), ("inner", "struct<a:string,b:bigint> False"), ("pairs", "map<bigint,struct<a:string,b:bigint>> False")]),
    "model_to_arrow": _values([("id", "int64 False"), ("d", "decimal128(12, 2) True"), ("tags", "list<element: string not null> False"), ("n", "struct<a: uint8 not null> False"), ("ts", "timestamp[ms, tz=Etc/UTC] False"), ("s", "string False")]),
    "model_to_pandas": _values([("id", "Int64"), ("s", "string")]),
    # Wider or as wide; a sign may be gained, and lost only between equal widths.
    "compare_lattice": "WITH k(name, signed, width) AS (VALUES ('INT_8', true, 8), ('INT_16', true, 16), ('INT_32', true, 32), ('INT_64', true, 64), ('UINT_8', false, 8), ('UINT_32', false, 32)) SELECT s.name || ' to ' || d.name AS name, CASE WHEN s.width = d.width OR (s.width < d.width AND (d.signed OR NOT s.signed)) THEN 'True' ELSE 'False' END AS value FROM k s, k d",
    "model_from_parquet": _values([("p_partkey", "INT_64"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"), ("p_size", "INT_32"), ("p_retailprice", "FLOAT_64")]),
    "model_paths": _values([("pick", "['day', 'key']"), ("find", "INT_64"), ("ids", "['key']")]),
    "export_ddl": _values([("again", True), ("engine", "MERGE_TREE"), ("order", "('id',)"), ("codec", "ZSTD")] + [(p, True) for p in ("LowCardinality(String)", "CODEC(Delta(4), ZSTD(7))", "Nullable(Decimal", "Array(String)", "ENGINE = MergeTree", "ORDER BY")]),
    "export_spark_ddl": _values([("id", "bigint"), ("d", "decimal(12,2)"), ("tags", "array<string>"), ("n", "struct<a:smallint>"), ("ts", "timestamp"), ("s", "string")]),
    "export_code": _values([("dataclass", True), ("scala", True), ("dbml", True), ("ansi", True), ("beam", "['id', 'd', 'tags', 'n', 'ts', 's']")]),
    "model_validate_columns": _values([(n, True) for n, *_ in _BAD]),
    "model_validate_tables": _values([("optional", 1), ("unknown", 1), ("engine", 1), ("granularity", 1), ("function", 0), ("twice", 1)]),
    "dq_kinds": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber >= 5) AS nodate FROM lineitem), u AS (SELECT coalesce(sum(k) FILTER (WHERE k > 1), 0)::BIGINT AS bad FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)) SELECT kind, \"column\", element_count, unexpected_count, unexpected_count = 0 AS success FROM (SELECT unnest(['exists', 'of_type', 'exists', 'of_type', 'exists', 'of_type', 'date_parseable', 'exists', 'exists', 'of_type', 'unique']) AS kind, unnest(['l_orderkey', 'l_orderkey', 'l_linenumber', 'l_linenumber', 'day', 'day', 'day', 'l_quantity', 'gone', 'gone', 'l_orderkey,l_linenumber']) AS \"column\", n AS element_count, unnest([0, 0, 0, 0, 0, 0, nodate, 0, 1, 1, bad]) AS unexpected_count FROM c, u)",
    "lineage_reach": _values([("inputs", "['other', 'src']"), ("query above src", True), ("dot nodes", True), ("less detail", True)]),
    "lineage_hints": _values([("inputs", "['a', 'b', 'big']"), ("outputs", "['big', 'fin']"), ("a", "TableA"), ("output", "Fin")]),
    "synth_numbers": _all_true("uniform", "normal", "exp", "geom", "pareto", "int", "val"),
    "synth_conversions": _all_true("toint", "todate", "todatetime", "tobool", "tostring", "tobytes"),
    "synth_texts": _all_true("str", "choice", "format", "concat", "faker"),
    "synth_defaults": _all_true("ids", "optional", "width", "repeated", "day", "stamp", "price", "nested", "path", "pattern"),
    "synth_collections": _all_true("array", '"set"', "dict"),
    "synth_same_for_any_partitions": "SELECT 0::BIGINT AS different",
}
