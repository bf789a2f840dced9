"""Quality, synthetic tables, joins, lineage, sinks, streams, entry points."""

import datetime
import json
import pickle

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from flowschema import quality
from flowschema.lineage import endpoints, endpoints_of_files, lineage, schema_hints, to_dot
from flowschema.model import ColumnSpec, Decimal, Label, Quality, TableSpec, Type
from flowschema.operators.joins import asof_join, range_join
from flowschema.plans import catalogue, checks
from flowschema.sources.sinks import Writer, write_shards
from flowschema.sql.lower import run
from flowschema.streaming import windows
from flowschema.synth import TableGenerator, build, generate_tables
from flowschema.synth.generators import Row


def test_shards_are_equal(spark, tmp_path):
    """However many tasks the rows come from, and if all rows are the same; maps have no hash of their own."""
    for k, rows in enumerate((spark.range(0, 1003, 1, 60), spark.range(0, 1003, 1, 60).selectExpr("1 AS id"), spark.range(0, 50, 1, 7).selectExpr("id", "map(id, 2) AS `m.n`"))):
        write_shards(rows, Writer("parquet"), str(tmp_path / f"p{k}"), 3)
        back = spark.read.parquet(str(tmp_path / f"p{k}"))
        counts = sorted(r["count"] for r in back.groupBy("shard").count().collect())
        assert len(counts) == 3 and counts[2] - counts[0] <= 1
        assert sorted(r.id for r in back.collect()) == sorted(r.id for r in rows.collect())
        assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / f"p{k}").glob("shard=*"))
    write_shards(spark.range(0, 1003, 1, 60), Writer("pickle"), str(tmp_path / "k"), 4)
    read = [pickle.loads(f.read_bytes()) for f in sorted((tmp_path / "k").glob("*.pickle"))]
    assert sorted(map(len, read)) == [250, 251, 251, 251] and sorted(r["id"] for x in read for r in x) == list(range(1003))


def test_every_query_but_open_ones_has_sql():
    names = set(catalogue.queries()) | set(checks.QUERIES)
    assert names <= set(__spark_entry__.queries()) and names <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["nation", "n_orders", "revenue"]


def test_quality(spark):
    t = TableSpec("t", (ColumnSpec("id", Type.INT_8, is_id=True), ColumnSpec("c", Type.STRING, Label.OPTIONAL, width=2, quality=Quality(values=("a", "bb", "ccc"), pattern="^[ab]"))))
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "ccc"), (2, "z")], "id int, c string").withColumn("id", F.col("id").cast("tinyint"))
    got = {(r.kind, r.column): r.unexpected_count for r in quality.evaluate(df, quality.expectations(t)).collect()}
    assert got == {("exists", "id"): 0, ("not_null", "id"): 1, ("of_type", "id"): 0, ("between", "id"): 0, ("exists", "c"): 0, ("of_type", "c"): 0, ("length_between", "c"): 1, ("in_set", "c"): 1, ("matches", "c"): 2, ("unique", "id"): 2}
    empty = quality.evaluate(df.limit(0), quality.expectations(t)).collect()
    assert all(r.success for r in empty)
    assert quality.orphans(df, "id", spark.sql("SELECT 1Y AS k"), "k").count() == 1


def make(spark, specs, n=200, parts=None):
    rows = spark.range(0, n, 1, parts) if parts else spark.range(n)
    return rows.select(*(build(v)(Row(F.col("id"), "t").at(k)).alias(k) for k, v in specs.items()))


def test_generators(spark):
    specs = {
        "inc": ("inc", 5, 2), "lim": ("inc", 0, 3, 10), "none": None, "val": ("val", "x"), "seq": ("seq", 1, ("int", 0, 4)), "u": ("uniform", 1, 2), "e": ("exp", 2.0), "g": ("geom", 0.3), "p": ("pareto", 2.0),
        "i": ("int", 3, 9), "c": ("choice", ["x", "y", None], [1, 2, 1]), "s": ("str", ("int", 3, 6)), "ar": ("array", ("int", 0, 5), ("int", 0, 3)), "se": ("set", ("int", 0, 3), 5), "d": ("dict", ("int", 0, 3), ("str", 2), 3),
        "dt": ("date", "2020-01-01", ("int", 0, 9)), "f": ("format", "{}-{:03d}", "k", ("inc", 1)), "ne": ("nested", {"x": ("inc", 0), "y": ("field", "x", -1, 1)}), "ap": ("apply", lambda x: str(x * 2), [("inc", 1)], "string"),
    }
    one, two = make(spark, specs).collect(), make(spark, specs, parts=7).collect()
    assert sorted(one, key=lambda r: r.inc) == sorted(two, key=lambda r: r.inc), "values must not depend on partitions"
    one.sort(key=lambda r: r.inc)
    assert [r.inc for r in one[:3]] == [5, 7, 9] and [r.lim for r in one[:5]] == [0, 3, 6, 9, 2]
    assert all(r.none is None and r.val == "x" and 1 <= r.u < 2 and r.e >= 0 and r.g >= 1 and r.p >= 0 and 3 <= r.i < 9 for r in one)
    assert all(r.seq == list(range(1, 1 + len(r.seq))) for r in one) and {len(r.seq) for r in one} == {0, 1, 2, 3}
    assert {r.c for r in one} == {"x", "y", None} and all(3 <= len(r.s) < 6 for r in one)
    assert all(len(set(r.se)) == len(r.se) for r in one) and all(len(r.ar) < 3 for r in one)
    assert one[0].f == "k-001" and one[0].ne.y == -1 and one[5].ne.y == 4 and one[3].ap == "8"
    assert all(datetime.date(2020, 1, 1) <= r.dt < datetime.date(2020, 1, 10) for r in one)


def test_bad_specs():
    for bad in (("nosuch", 1), ("geom", 0.0), ("choice", [])):
        with pytest.raises(ValueError):
            build(bad)
    with pytest.raises(ValueError):
        build(("nested", {"x": ("field", "x", 0, 1)}))(Row(F.lit(1)))


def test_tables_share_keys(spark):
    a = TableSpec("a", (ColumnSpec("a_id", Type.INT_64, is_id=True), ColumnSpec("x", Type.DECIMAL, Label.OPTIONAL, decimal=Decimal(10, 2)), ColumnSpec("s", Type.SET, fields=(ColumnSpec("element", Type.INT_32),))))
    b = TableSpec("b", (ColumnSpec("b_id", Type.STRING, is_id=True), ColumnSpec("a_id", Type.INT_64), ColumnSpec("r", Type.STRING, Label.REPEATED)))
    t = generate_tables(spark, [b, a], {"a": 40, "b": 300})
    assert list(t) == ["a", "b"] and sorted(r.a_id for r in t["a"].collect()) == list(range(1, 41))
    assert t["b"].join(t["a"], "a_id", "left_anti").count() == 0 and t["b"].select("a_id").distinct().count() > 20
    assert t["b"].first().b_id == "b_id_1"
    assert TableGenerator(a, 5, {"x": ("val", 1)}).frame(spark).agg(F.sum("x")).first()[0] == 5


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 2, "z"), (None, 1, "n")], "k string, t int, v string")
    got = lambda op, outer=True: {r.l.id: r.r.v if r.r else None for r in asof_join(left, right, [("k", "k")], ("t", op, "t"), outer).collect()}
    assert got(">=") == {1: "x", 2: "y", 3: None, 4: None, 5: None}
    assert got(">") == {1: None, 2: "y", 3: None, 4: None, 5: None}
    assert got("<=") == {1: "x", 2: None, 3: "z", 4: None, 5: None}
    assert got(">=", False) == {1: "x", 2: "y"}
    bands = spark.createDataFrame([("p", 0.0, 6.0), ("q", 5.0, 20.0), ("none", 3.0, 3.0)], "n string, low double, high double")
    pairs = range_join(left.where("t IS NOT NULL"), bands, "t", "low", "high", 4.0).collect()
    assert sorted((r.id, r.n) for r in pairs) == [(1, "p"), (1, "q"), (2, "q"), (3, "p"), (4, "q")]


def test_lineage(tmp_path, spark):
    g = lineage("WITH c AS (SELECT x, y FROM src) SELECT c.x AS z, (SELECT max(q) FROM other) FROM c WHERE y > 1")
    assert g.inputs() == ["other", "src"] and g.outputs() == []
    src = next(n.id for n in g.nodes if n.name == "src")
    assert next(n.id for n in g.nodes if n.kind == "query") in g.reach({src}, down=False)
    assert to_dot(g, 0).count("->") == 1 and "digraph" in to_dot(g)
    two = endpoints("CREATE TABLE n AS SELECT * FROM m; INSERT INTO o SELECT * FROM n JOIN k USING (i)")
    assert two.inputs == ["k", "m", "n"] and two.outputs == ["n", "o"]
    assert schema_hints("--@Schema: t Orders\n--@Output: Out\nSELECT 1") == {"t": "Orders", "": "Out"}
    (tmp_path / "a.sql").write_text("INSERT INTO x SELECT * FROM y")
    (tmp_path / "b.sql").write_text("SELECT FROM")
    rows = endpoints_of_files(spark, str(tmp_path)).collect()
    assert sorted((r.role, r.name) for r in rows if r.role != "error") == [("input", "y"), ("output", "x")]
    assert sum(r.role == "error" for r in rows) == 1


def test_clickhouse_run(spark):
    spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, a array<int>").createOrReplaceTempView("arrays")
    rows = run(spark, "SELECT k, x FROM arrays LEFT ARRAY JOIN a AS x", "clickhouse").collect()
    assert sorted((r.k, r.x or 0) for r in rows) == [(1, 1), (1, 2), (2, 0), (3, 0)]
    rows = run(spark, "SELECT k, a FROM arrays ARRAY JOIN a", "clickhouse").collect()
    assert sorted((r.k, r.a) for r in rows) == [(1, 1), (1, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, [1]), (2, None, [])], "i int, f double, l array<int>")
    Writer("csv", {"sep": ";", "na_rep": "NA", "float_format": "%.3f", "index": True}).write(df.coalesce(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "index;i;f;l" in text and "0;1;2.500;" in text and ";NA;" in text
    Writer("parquet", {"compression": "zstd", "use_dictionary": False}).write(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    Writer("pickle").write(df, str(tmp_path / "k"))
    read = lambda folder: [r for p in sorted((tmp_path / folder).glob("*.pickle")) for r in pickle.loads(p.read_bytes())]
    assert sorted(read("k"), key=lambda r: r["i"]) == [{"i": 1, "f": 2.5, "l": [1]}, {"i": 2, "f": None, "l": []}]
    with pytest.raises(FileExistsError):
        Writer("pickle").write(df, str(tmp_path / "k"))
    Writer("json", {"document": True}).write(df.coalesce(1), str(tmp_path / "d"))
    assert json.loads((tmp_path / "d" / "part-00000.json").read_text()) == [{"i": 1, "f": 2.5, "l": [1]}, {"i": 2, "f": None, "l": []}]
    Writer("json", {"document": True}).write(df.limit(0).coalesce(1), str(tmp_path / "e"))
    wide = df.select(F.col("i").cast("decimal(20,0)").alias("u"))
    Writer("parquet", {"no_uint": True}).write(wide, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).dtypes == [("u", "bigint")]
    write_shards(df, Writer("csv", {"na_rep": "NULL"}), str(tmp_path / "w"), 2)
    lines = [x for p in (tmp_path / "w").rglob("*.csv") for x in p.read_text().splitlines()]
    assert lines.count("i,f,l") == 2 and sum(x.startswith("2,NULL,") for x in lines) == 1
    with pytest.raises(ValueError):
        write_shards(df, Writer("print"), str(tmp_path / "x"), 2)
    assert write_shards(spark.range(100), Writer("json"), str(tmp_path / "s"), 3) == [f"data_{i:05d}-of-00003" for i in range(3)]
    assert spark.read.json(str(tmp_path / "s")).count() == 100


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), events))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))


def test_plans_push_and_prune(spark):
    df = catalogue.query("sql_filter_project")(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_quantity" in plan.split("PushedFilters")[1] and "l_comment" not in plan and "l_shipdate" not in plan
