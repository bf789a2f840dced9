"""Round trips, statement models, and what the lowering writes."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from flowschema.sql import SqlError, parse, parse_one, to_sql
from flowschema.sql import ast as A
from flowschema.sql import lower
from flowschema.sql.lower import run, Keys, to_spark_sql
from flowschema.sql.parser import parse_with_text

BOTH = [
    "SELECT o_orderkey FROM orders",
    "SELECT o_orderkey AS k, c.* FROM orders AS c WHERE k = 10",
    "SELECT COUNT(1) FROM part WHERE p_size > 1 GROUP BY (1, 2)",
    "SELECT a FROM t GROUP BY a WITH ROLLUP",
    "SELECT a FROM t GROUP BY ROLLUP (a) HAVING a > 10",
    "SELECT a FROM t ORDER BY a DESC NULLS FIRST LIMIT 10 OFFSET 20",
    "SELECT x + 10 AS y FROM (SELECT x FROM t)",
    "SELECT a FROM t WHERE a IN (SELECT k FROM s WHERE q > 1)",
    "SELECT a FROM t WHERE EXISTS((SELECT COUNT(1) FROM s WHERE q > 1))",
    "SELECT a FROM (t LEFT JOIN s ON (t.q = s.q)) JOIN e ON t.a = e.a",
    "SELECT a FROM t LEFT JOIN s USING (q, m)",
    "WITH z AS (SELECT a FROM t) SELECT x FROM u LEFT JOIN z ON z.k = u.k WHERE y > 10",
    "SELECT CASE WHEN a BETWEEN 1 AND 2 THEN 'x' ELSE 'y' END FROM ${db}.t",
    "SELECT sum(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t",
    "SELECT CAST(a AS DECIMAL(10, 2)), EXTRACT(YEAR FROM d), INTERVAL 3 DAY FROM t",
]
SPARK = [
    "SELECT a FROM t ORDER BY a SORT BY b",
    "SELECT a FROM t DISTRIBUTE BY a, b",
    "SELECT a, b FROM t GROUP BY a WITH ROLLUP GROUPING SETS ((a), (a, b), ()) DISTRIBUTE BY b",
    "SELECT * FROM p PIVOT (SUM(x) AS s, AVG(y) AS v FOR z IN ('J' AS j, 'M' AS m))",
    "SELECT * FROM p LATERAL VIEW EXPLODE(ARRAY(3, 6)) tn AS c, LATERAL VIEW OUTER EXPLODE(ARRAY(4, 8)) AS d",
    "SELECT * FROM p LATERAL TABLE (VALUES ('one', 1), ('two', 2)) AS n (name, value)",
    "SELECT transform(a, x -> x + 1), aggregate(a, 0, (s, x) -> s + x) FROM t",
]
CLICKHOUSE = [
    "SELECT DISTINCT TOP 5 a FROM t",
    "SELECT a FROM t FINAL SAMPLE 2 / 3 OFFSET 1 / 2",
    "SELECT a FROM t GROUP BY CUBE (a) WITH ROLLUP WITH TOTALS ORDER BY b",
    "SELECT a FROM t GLOBAL ANY LEFT JOIN s USING (k)",
    "SELECT a FROM t LEFT ARRAY JOIN b AS x, q(y)",
    "WITH call(20) AS b SELECT x FROM s",
    "SELECT a FROM t LIMIT 10 OFFSET 20 WITH TIES",
    "SELECT a FROM t LIMIT 10 OFFSET 20 BY check(b)",
    "SELECT a ? 1 : 2, [1, 2][1], quantile(0.9)(a) FROM t PREWHERE a > 1 WHERE b",
]


@pytest.mark.parametrize("text,dialect", [(t, d) for t in BOTH for d in ("spark", "clickhouse")] + [(t, "spark") for t in SPARK] + [(t, "clickhouse") for t in CLICKHOUSE])
def test_round_trip(text, dialect):
    assert to_sql(parse_one(text, dialect)) == text
    assert to_sql(parse_one(to_sql(parse_one(text, dialect)), dialect)) == text


names = st.from_regex(r"c[0-9]{1,3}", fullmatch=True)
values = st.one_of(names, st.integers(0, 99).map(str))
expressions = st.recursive(
    values,
    lambda x: st.one_of(st.tuples(x, st.sampled_from(["+", "*", "=", "<"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), x.map(lambda a: f"f({a})"), st.tuples(x, x).map(lambda t: f"CASE WHEN {t[0]} THEN {t[1]} END"), x.map(lambda a: f"NOT ({a})")),
    max_leaves=8,
)


@given(expressions, st.sampled_from(["spark", "clickhouse"]))
def test_generated_expressions_round_trip(x, dialect):
    text = f"SELECT {x} FROM t"
    assert to_sql(parse_one(text, dialect)) == text


def test_statements_and_their_texts():
    found = parse_with_text("SELECT 1;; USE db ; DROP VIEW IF EXISTS a.b;", "spark")
    assert [type(s).__name__ for s, _ in found] == ["Query", "DbUse", "Drop"]
    assert [t for _, t in found] == ["SELECT 1", "USE db", "DROP VIEW IF EXISTS a.b"]


def test_create_insert_database():
    c = parse_one("CREATE OR REPLACE TEMPORARY VIEW v USING parquet OPTIONS (path '/x/y')")
    assert (c.kind, c.replace, c.format, c.options) == ("TEMPORARY VIEW", True, "parquet", {"path": "'/x/y'"})
    i = parse_one("INSERT OVERWRITE TABLE x PARTITION (d = 1) SELECT a FROM t")
    assert i.overwrite and i.destination.name == ["x"] and i.partition == "(d = 1)"
    d = parse_one("CREATE DATABASE IF NOT EXISTS d COMMENT 'c' LOCATION 'l'")
    assert (d.name, d.if_not_exists, d.comment, d.location) == ("d", True, "'c'", "'l'")
    m = parse_one("CREATE MATERIALIZED VIEW v TO d ENGINE = MergeTree AS SELECT a FROM t", "clickhouse")
    assert m.kind == "MATERIALIZED VIEW" and m.to == ["d"] and isinstance(m.query, A.Query)


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT (a FROM t", "SELECT a b c FROM t", "SELECT 'open"])
def test_errors_name_a_place(text):
    with pytest.raises(SqlError, match=r"line \d+:\d+"):
        parse(text)


def test_lowering():
    assert "EXCEPT (__n" in to_spark_sql("SELECT a FROM t LIMIT 2 BY a", "clickhouse")
    assert to_spark_sql("SELECT a ? 1 : 2 FROM t", "clickhouse") == "SELECT if(a, 1, 2) FROM t"
    assert to_spark_sql("SELECT a FROM t LIMIT 10, 20") == "SELECT a FROM t LIMIT 20 OFFSET 10"
    assert to_spark_sql("SELECT a FROM t PREWHERE x WHERE y OR z", "clickhouse") == "SELECT a FROM t WHERE (x) AND (y OR z)"
    assert to_spark_sql("SELECT a FROM ${db}.t", variables={"db": "d"}) == "SELECT a FROM d.t"
    assert "max(struct(v AS v, struct(*) AS r)) AS __best FROM t GROUP BY k" in to_spark_sql("SELECT a FROM t FINAL", "clickhouse", keys={"t": Keys(["k"], "v")})
    for bad in ("SELECT a FROM t FINAL", "SELECT a FROM t LIMIT 2 WITH TIES"):
        with pytest.raises(SqlError):
            to_spark_sql(bad, "clickhouse")
    with pytest.raises(SqlError, match="no value"):
        to_spark_sql("SELECT a FROM ${db}.t")


def test_clickhouse_is_not_read_as_aliases(spark):
    """Spark's own parser would take ANY and FINAL for table aliases; the lowering must not let that happen."""
    out = to_spark_sql("SELECT a FROM t ANY LEFT JOIN s USING (k)", "clickhouse")
    assert "ANY" not in out and "min(struct(*))" in out and "GROUP BY k" in out
    spark._jsparkSession.sessionState().sqlParser().parsePlan(out)


def test_totals_beside_rollup_and_cube():
    assert to_spark_sql("SELECT a, b, count() FROM t GROUP BY a, b WITH ROLLUP WITH TOTALS", "clickhouse").endswith("GROUP BY GROUPING SETS ((a, b), (a), (), ())")
    assert to_spark_sql("SELECT a, count() FROM t GROUP BY CUBE(a) WITH TOTALS", "clickhouse").endswith("GROUP BY GROUPING SETS ((), (a), ())")


def test_storage_clauses():
    text = to_spark_sql("CREATE TABLE t (a INT) PARTITIONED BY (p STRING) CLUSTERED BY (a) SORTED BY (a) INTO 4 BUCKETS SKEWED BY (a) ON ((1), (2)) STORED AS DIRECTORIES STORED AS ORC")
    assert "USING orc" in text and "CLUSTERED BY (a) SORTED BY (a) INTO 4 BUCKETS" in text and "SKEWED" not in text and "STORED" not in text
    text = to_spark_sql("CREATE TABLE t (a INT) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' NULL DEFINED AS 'x' STORED AS TEXTFILE AS SELECT 1 AS a")
    assert "USING csv" in text and "sep ','" in text and "nullValue 'x'" in text and text.endswith("AS SELECT 1 AS a")
    assert "USING parquet" in to_spark_sql("CREATE TABLE t (a INT) STORED AS INPUTFORMAT 'x.ParquetIn' OUTPUTFORMAT 'x.ParquetOut'")


def test_materialized_view_fills_its_target():
    assert to_spark_sql("CREATE MATERIALIZED VIEW v TO t AS SELECT 1 AS a", "clickhouse") == "INSERT INTO t SELECT 1 AS a"


def test_tuples_and_floats_of_clickhouse():
    assert to_spark_sql("SELECT (a, b).2, t.1, 0.5 FROM t", "clickhouse") == "SELECT b, t.col1, 0.5D FROM t"


def test_settings_and_format_are_said_to_have_no_effect(spark):
    with pytest.warns(UserWarning, match="SETTINGS and FORMAT"):
        assert run(spark, "SELECT 1 AS a SETTINGS max_threads = 1 FORMAT JSON", "clickhouse").count() == 1


def test_exact_aggregates_are_read_apart(spark):
    """Over all rows, beside other aggregates: neither a distinct count of Spark nor its exact percentile, with their results."""
    nan, inf = float("nan"), float("inf")
    many = [(i % 7, (i * 7919 % 4001) / 8) for i in range(4001)]
    cases = ([], [(None, None)], [(1, 2.0)], [(1, 2.0), (1, 4.0)], [(1, nan), (2, 1.0), (None, 2.0)], [(1, inf), (2, 1.0)], [(1, 5.0)] * 500 + [(2, 6.0)] * 501, [*many, (None, None)])
    for k, rows in enumerate(cases):
        spark.createDataFrame(rows, "a int, b double").createOrReplaceTempView("exact_rows")
        for where in ("", " WHERE b > 100 OR a IS NULL") if k == 7 else ("",):
            for level in (0, 0.001, 0.77, 1) if k == 7 else (0.5,):
                text = f"SELECT uniqExact(a) AS u, uniqExact(a, b) AS w, round(quantileExact({level})(b), 6) AS q, median(b) AS m, count() AS n, sum(a) + uniqExact(a % 3) AS s FROM exact_rows{where}"
                made = to_spark_sql(text, "clickhouse")
                assert "count(DISTINCT" not in made and "percentile(" not in made
                want = f"SELECT count(DISTINCT a) AS u, count(DISTINCT a, b) AS w, round(percentile(b, {level}D), 6) AS q, percentile(b, 0.5D) AS m, count(*) AS n, sum(a) + count(DISTINCT a % 3) AS s FROM exact_rows{where}"
                assert repr(run(spark, text, "clickhouse").collect()) == repr(spark.sql(want).collect()), (k, level, where)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT uniqExact(a) AS u FROM t",
        "SELECT uniqExact(a), count() FROM t",
        "SELECT k, uniqExact(a) AS u, count() AS n FROM t GROUP BY k",
        "SELECT uniqExact(a) AS u, count() AS n FROM (SELECT a FROM t LIMIT 5)",
        "WITH t AS (SELECT a FROM s LIMIT 5) SELECT uniqExact(a) AS u, count() AS n FROM t",
        "SELECT b + 1 AS c, uniqExact(c) AS u, count() AS n FROM t",
        "SELECT uniqExact(a) AS u, count() AS n FROM t WHERE rand() > 7",
        "SELECT a FROM s WHERE 1 = (SELECT uniqExact(a) + count() AS u FROM t WHERE t.k = s.k)",
    ],
)
def test_exact_aggregates_that_stay(text):
    assert "count(DISTINCT" in to_spark_sql(text, "clickhouse")


def test_rows_meet_before_they_are_exploded(spark, tmp_path, monkeypatch):
    """If the columns of the table spread its rows; the exploded rows then go through no shuffle. Equal results, with repeated and null keys."""
    made = spark.range(0, 3000, 1, 4).selectExpr("nullif(id % 1000, 7) AS k", "id % 3 AS few", "concat_ws(' ', 'a', id % 5, 'a', id) AS text", "array(id % 2, id % 2, 9) AS xs")
    made.write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("met")
    apart = []
    cases = [
        ("spark", "SELECT k, w, count(*) AS n FROM met LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY k, w", True),
        ("spark", "SELECT m.k, w, x, count(*) AS n FROM met m LATERAL VIEW OUTER explode(split(text, ' ')) t AS w LATERAL VIEW explode(xs) u AS x WHERE m.k > 5 AND w <> 'a' GROUP BY m.k, w, x", True),
        ("clickhouse", "SELECT k, x, sum(few) AS n FROM met ARRAY JOIN xs AS x GROUP BY k, x", True),
        ("spark", "SELECT few, w, count(*) AS n FROM met LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY few, w", False),
        ("spark", "SELECT k, count(*) AS n FROM met LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY k", False),
        ("spark", "SELECT k, w, count(*) AS n FROM met LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY k, w WITH ROLLUP", False),
    ]
    for size in (1 << 40, 2048):
        monkeypatch.setattr(lower, "PART_BYTES", size)
        for dialect, text, meets in cases:
            out = run(spark, text, dialect)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("REPARTITION_BY_NUM" in plan) == (meets and size == 2048), text
            assert plan.count("Exchange") == 1, text
            apart.append(sorted(map(repr, out.collect())))
    assert apart[: len(cases)] == apart[len(cases) :] and all(apart)
