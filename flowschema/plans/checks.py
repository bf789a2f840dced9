"""Queries of the schema, quality, synthetic-data, lineage, join and window operators, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import compare, quality
from ..bridge import from_spark
from ..lineage import endpoints, lineage
from ..model import ColumnSpec, Decimal, Label, Quality, TableSpec, Timestamp, Type
from ..operators.joins import asof_join, range_join
from ..sources.clickhouse_ddl import from_clickhouse_ddl
from ..streaming import windows
from ..synth import TableGenerator, generate_tables
from .catalogue import FLAGSHIP


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


ORDERS = TableSpec(
    "orders",
    (
        ColumnSpec("o_orderkey", Type.INT_64, is_id=True), ColumnSpec("o_custkey", Type.INT_64, join_reference="customer"), ColumnSpec("o_orderstatus", Type.STRING, width=1, quality=Quality(values=("F", "O"))),
        ColumnSpec("o_totalprice", Type.FLOAT_64), ColumnSpec("o_orderdate", Type.DATETIME_64, timestamp=Timestamp(6)), ColumnSpec("o_orderpriority", Type.STRING, width=8, quality=Quality(pattern="^[1-5]-")),
    ),
)
NEXT_ORDERS = TableSpec(
    "orders_v2",
    (
        ColumnSpec("o_orderkey", Type.INT_64, is_id=True), ColumnSpec("o_custkey", Type.INT_32), ColumnSpec("o_orderstatus", Type.STRING, Label.OPTIONAL), ColumnSpec("o_totalprice", Type.DECIMAL, decimal=Decimal(14, 2)),
        ColumnSpec("o_orderdate", Type.INT_64), ColumnSpec("o_note", Type.STRING, Label.OPTIONAL),
    ),
)


def dq_expectations_orders(spark: SparkSession, folder: str) -> DataFrame:
    found = [e for e in quality.expectations(ORDERS) if e.kind in ("not_null", "in_set", "length_between", "matches", "between", "unique")]
    return quality.evaluate(_read(spark, folder, "orders"), found)


def dq_fk_customer(spark: SparkSession, folder: str) -> DataFrame:
    return quality.orphans(_read(spark, folder, "customer"), "c_custkey", _read(spark, folder, "orders"), "o_custkey").select("c_custkey")


def schema_diff_orders(spark: SparkSession, folder: str) -> DataFrame:
    return compare.diff_frame(spark, compare.compare(NEXT_ORDERS, ORDERS)).select("code", "column", "convertible")


def schema_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    t = from_spark(_read(spark, folder, "orders").schema, "orders")
    return spark.createDataFrame([(c.name, c.type.name, c.label.name) for c in t.columns], "name string, type string, label string")


def coerce_orders(spark: SparkSession, folder: str) -> DataFrame:
    return compare.coerce(_read(spark, folder, "orders"), NEXT_ORDERS, ORDERS)


def ddl_import(spark: SparkSession, folder: str) -> DataFrame:
    t = from_clickhouse_ddl("CREATE TABLE d.t (id UInt64 CODEC(Delta(8), ZSTD(3)), tags Array(LowCardinality(String)), at Nullable(DateTime64(3, 'UTC')), m Map(String, Int32)) ENGINE = MergeTree ORDER BY (id)")
    return spark.createDataFrame([(c.name, c.type.name, c.label.name) for c in t.columns], "name string, type string, label string")


def synth_sequence(spark: SparkSession, folder: str) -> DataFrame:
    t = TableSpec("dims", (ColumnSpec("id", Type.INT_64), ColumnSpec("day", Type.DATE), ColumnSpec("code", Type.STRING), ColumnSpec("name", Type.STRING), ColumnSpec("before", Type.INT_64)))
    specs = {"id": ("inc", 10, 3), "day": ("date", "2020-01-01", ("inc", 0, 1, 100)), "code": ("format", "{}-{:04d}", "k", ("inc", 1)), "name": ("concat", ["x", ("inc", 5)], "_"), "before": ("field", "id", -1, 2)}
    return TableGenerator(t, 1000, specs).frame(spark, 3)


def synth_keys(spark: SparkSession, folder: str) -> DataFrame:
    a = TableSpec("a", (ColumnSpec("a_id", Type.INT_64, is_id=True), ColumnSpec("x", Type.FLOAT_64)))
    b = TableSpec("b", (ColumnSpec("b_id", Type.INT_64, is_id=True), ColumnSpec("a_id", Type.INT_64)))
    t = generate_tables(spark, [b, a], {"a": 100, "b": 1000})
    lost = t["b"].join(t["a"], "a_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return lost.crossJoin(t["a"].agg(F.min("a_id").alias("first"), F.max("a_id").alias("last"), F.count_distinct("a_id").alias("keys")))  # one row each


def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    _, edges = lineage(FLAGSHIP).frames(spark)
    return edges.where("kind IN ('FROM', 'LINEAGE')").select("from_name", "kind", "to_name")


def lineage_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    e = endpoints("CREATE TABLE big AS SELECT * FROM orders WHERE o_totalprice > 1; INSERT INTO report WITH c AS (SELECT * FROM customer) SELECT * FROM big JOIN c ON o_custkey = c_custkey")
    return spark.createDataFrame([("input", n) for n in e.inputs] + [("output", n) for n in e.outputs], "role string, name string")


def asof_events(spark: SparkSession, folder: str) -> DataFrame:
    events = _read(spark, folder, "events")
    out = asof_join(events.where("event_type = 'click'"), events.where("event_type = 'view'"), [("user_id", "user_id")], ("ts", ">", "ts"))
    return out.select(F.col("l.event_id").alias("id"), F.col("r.event_id").alias("before"))


def range_join_price(spark: SparkSession, folder: str) -> DataFrame:
    bands = spark.createDataFrame([(i, i * 50.0 + 900, i * 50.0 + 1010) for i in range(20)], "band int, low double, high double")
    return range_join(_read(spark, folder, "part"), bands, "p_retailprice", "low", "high", 50.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def window_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return windows.tumbling(_read(spark, folder, "events")).select("start", "event_type", "n")


def window_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sessions(_read(spark, folder, "events"))


_COUNT = "SELECT '{kind}' AS kind, '{column}' AS \"column\", count(*) AS element_count, count(*) FILTER (WHERE {bad}) AS unexpected_count, count(*) FILTER (WHERE {bad}) = 0 AS success FROM orders"
_CHECKS = [("not_null", c, f"{c} IS NULL") for c in ORDERS.names()] + [
    ("between", "o_orderkey", "false"), ("between", "o_custkey", "false"), ("length_between", "o_orderstatus", "length(o_orderstatus) > 1"), ("in_set", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')"),
    ("length_between", "o_orderpriority", "length(o_orderpriority) > 8"), ("matches", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-5]-')"),
    ("unique", "o_orderkey", "o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)"),
]

QUERIES = {
    f.__name__: f
    for f in (dq_expectations_orders, dq_fk_customer, schema_diff_orders, schema_of_orders, coerce_orders, ddl_import, synth_sequence, synth_keys, lineage_edges, lineage_endpoints, asof_events, range_join_price, window_tumbling, window_sessions)
}
ORACLE_SQL = {
    "dq_expectations_orders": " UNION ALL ".join(_COUNT.format(kind=k, column=c, bad=b) for k, c, b in _CHECKS),
    "dq_fk_customer": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "schema_diff_orders": "SELECT * FROM (VALUES ('TABLE_NAMES', NULL, true), ('NOT_FOUND_DEST', 'o_orderpriority', false), ('NOT_FOUND_SRC', 'o_note', true), ('TYPES_INCOMPATIBLE', 'o_custkey', false), ('LABEL_CONVERTIBLE', 'o_orderstatus', true), ('TYPES_INCOMPATIBLE', 'o_totalprice', false), ('TYPES_DIFFERENT_CONVERTIBLE', 'o_orderdate', true)) t(code, \"column\", convertible)",
    "schema_of_orders": "SELECT * FROM (VALUES ('o_orderkey', 'INT_64', 'OPTIONAL'), ('o_custkey', 'INT_64', 'OPTIONAL'), ('o_orderstatus', 'STRING', 'OPTIONAL'), ('o_totalprice', 'FLOAT_64', 'OPTIONAL'), ('o_orderdate', 'DATETIME_64', 'OPTIONAL'), ('o_orderpriority', 'STRING', 'OPTIONAL')) t(name, type, label)",
    "coerce_orders": "SELECT o_orderkey, o_custkey::INTEGER AS o_custkey, o_orderstatus, round(o_totalprice, 2)::DECIMAL(14, 2) AS o_totalprice, epoch_us(o_orderdate) AS o_orderdate, NULL::VARCHAR AS o_note FROM orders",
    "ddl_import": "SELECT * FROM (VALUES ('id', 'UINT_64', 'REQUIRED'), ('tags', 'STRING', 'REPEATED'), ('at', 'DATETIME_64', 'OPTIONAL'), ('m', 'MAP', 'REQUIRED')) t(name, type, label)",
    "synth_sequence": "SELECT 10 + 3 * i AS id, DATE '2020-01-01' + CAST(i % 100 AS INTEGER) AS day, format('k-{:04d}', i + 1) AS code, 'x_' || (i + 5) AS name, CASE WHEN i >= 2 THEN 10 + 3 * (i - 2) ELSE -1 END AS before FROM range(1000) t(i)",
    "synth_keys": "SELECT 0::BIGINT AS orphans, 1::BIGINT AS first, 100::BIGINT AS last, 100::BIGINT AS keys",
    "lineage_edges": "SELECT * FROM (VALUES ('query:', 'FROM', 'table:orders'), ('query:', 'FROM', 'table:customer'), ('query:', 'FROM', 'table:nation'), ('column:nation', 'LINEAGE', 'table:nation'), ('expression:round(sum(o.o_totalprice), 2)', 'LINEAGE', 'table:orders'), ('expression:count(*)', 'LINEAGE', 'table:orders'), ('expression:count(*)', 'LINEAGE', 'table:customer'), ('expression:count(*)', 'LINEAGE', 'table:nation')) t(from_name, kind, to_name)",
    "lineage_endpoints": "SELECT * FROM (VALUES ('input', 'big'), ('input', 'customer'), ('input', 'orders'), ('output', 'big'), ('output', 'report')) t(role, name)",
    "asof_events": "SELECT a.event_id AS id, b.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts > b.ts",
    "range_join_price": "SELECT i::INTEGER AS band, count(*) AS n FROM part JOIN range(20) t(i) ON p_retailprice >= i * 50 + 900 AND p_retailprice < i * 50 + 1010 GROUP BY i",
    "window_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "window_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
}
