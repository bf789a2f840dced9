"""Data-quality expectations of a table, evaluated in one aggregation pass (and one grouping for uniqueness).

Value checks skip nulls. All checks of one table are aggregates of one job with a partial combine in each task, whatever their
number; uniqueness is a grouping by the keys; a reference check is an anti join. Nothing is collected but one row of counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bridge import _element
from .model import INTEGERS, UNSIGNED, TableSpec, Type


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None
    details: dict = field(default_factory=dict, hash=False)


def expectations(t: TableSpec) -> list[Expectation]:
    """What the model says about the data, column by column in order, then uniqueness of the key."""
    out = []
    for i, c in enumerate(t.columns):
        q = c.quality
        out.append(Expectation("exists", c.name, {"index": i}))
        nullable = q.nullable if q and q.nullable is not None else c.is_optional
        if not nullable:
            out.append(Expectation("not_null", c.name))
        if q and q.ignored:
            continue
        out.append(Expectation("of_type", c.name, {"type": _element(c).simpleString()}))
        if not c.is_repeated:
            if c.type in INTEGERS:
                half = 1 << INTEGERS[c.type] - 1
                out.append(Expectation("between", c.name, {"low": -half, "high": half - 1}))
            elif c.type in UNSIGNED:
                out.append(Expectation("between", c.name, {"low": 0, "high": (1 << UNSIGNED[c.type]) - 1}))
            if c.width is not None:
                out.append(Expectation("length_between", c.name, {"low": 0, "high": c.width}))
            if q and q.values:
                out.append(Expectation("in_set", c.name, {"values": list(q.values)}))
            if q and q.format:
                out.append(Expectation("date_parseable", c.name, {"format": q.format}))
            if q and q.pattern:
                out.append(Expectation("matches", c.name, {"pattern": q.pattern}))
    if ids := t.ids():
        out.append(Expectation("unique", ids[0] if len(ids) == 1 else None, {"columns": ids}))
    return out


def _bad(e: Expectation) -> Column | None:
    """True for a value that breaks the expectation."""
    c = F.col(f"`{e.column}`") if e.column else None
    d = e.details
    if e.kind == "not_null":
        return c.isNull()
    if e.kind == "between":
        wide = F.lit(str(d["high"])).cast("decimal(20,0)") if d["high"] >= 1 << 63 else F.lit(d["high"])
        return ~c.between(F.lit(d["low"]), wide)
    if e.kind == "length_between":
        return ~F.length(c).between(d["low"], d["high"])
    if e.kind == "in_set":
        return ~c.isin(d["values"])
    if e.kind == "matches":
        return ~c.rlike(d["pattern"])
    if e.kind == "date_parseable":
        return F.try_to_timestamp(c).isNull() & c.isNotNull()
    return None


def evaluate(df: DataFrame, expected: list[Expectation]) -> DataFrame:
    """One row per expectation: kind, column, element_count, unexpected_count, success."""
    spark = df.sparkSession
    present = {c: t for c, t in df.dtypes}
    checks, fixed = [], {}
    for i, e in enumerate(expected):
        if e.kind == "exists":
            at = df.columns.index(e.column) if e.column in present else -1
            fixed[i] = 0 if at == e.details.get("index", at) and at >= 0 else 1
        elif e.kind == "unique":
            continue
        elif e.column not in present:
            fixed[i] = 1
        elif e.kind == "of_type":
            fixed[i] = int(present[e.column] != e.details["type"])
        else:
            checks.append((i, F.count_if(F.coalesce(_bad(e), F.lit(False))).alias(f"c{i}")))
    unique = [(i, e) for i, e in enumerate(expected) if e.kind == "unique"]
    # Counts stay in the plan: each one-row aggregate is unpivoted into rows, nothing is collected.
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(c for _, c in checks))
    parts = [F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("bad")) for i, _ in checks] + [F.struct(F.lit(i).alias("i"), F.lit(bad).cast("long").alias("bad")) for i, bad in fixed.items()]
    rows = counts.select("n", F.inline(F.array(*parts))) if parts else spark.createDataFrame([], "n long, i int, bad long")
    for i, e in unique:
        keys = [F.col(f"`{c}`") for c in e.details["columns"]]
        groups = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in e.details["columns"]))).groupBy(*keys).count()
        rows = rows.unionByName(groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("bad")).select("n", F.lit(i).alias("i"), "bad"))
    names = spark.createDataFrame([(i, e.kind, e.column or ",".join(e.details.get("columns", []))) for i, e in enumerate(expected)], "i int, kind string, column string")
    return rows.join(F.broadcast(names), "i").select("kind", "column", F.col("n").alias("element_count"), F.col("bad").alias("unexpected_count"), (F.col("bad") == 0).alias("success"))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose column is no key of parent (nulls refer to nothing and are left alone)."""
    keys = parent.select(F.col(key).alias("__key"))
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")
