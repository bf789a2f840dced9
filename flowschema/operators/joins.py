"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], near: tuple[str, str, str], outer: bool = True, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """For each left row the nearest right row with equal keys that meets the inequality near = (left column, op, right column).

    Returns two struct columns called names. Both sides are put in one sequence per key and a running last (for > and >=)
    or first-to-come (for < and <=) value is carried along: one shuffle by key and one sort, linear in the rows, where a
    range join would be quadratic in a key's rows. Of right rows with the same position the greatest (compared column by
    column) is taken. Null keys and null positions match nothing."""
    l_at, op, r_at = near
    back, strict = op in (">", ">="), op in (">", "<")
    key_names = [f"k{i}" for i in range(len(keys))]
    ok = lambda at, cols: F.col(at).isNotNull() & F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols) or "true")
    row = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    # Rank of the sides at one position: the right side goes first unless equality doesn't count.
    one = left.select(*(F.col(a).alias(k) for k, (a, _) in zip(key_names, keys)), F.col(l_at).alias("at"), F.lit(0 if strict else 1).alias("side"), row(left).alias("l"), ok(l_at, [a for a, _ in keys]).alias("fits"))
    two = right.where(ok(r_at, [b for _, b in keys]))
    two = two.select(*(F.col(b).alias(k) for k, (_, b) in zip(key_names, keys)), F.col(r_at).alias("at"), F.lit(1 if strict else 0).alias("side"), row(right).alias("r"), F.lit(True).alias("fits"))
    # Left rows that match nothing keep out of the shuffle: a null key is no group of its own.
    alone = one.where(~F.col("fits")).select("l", F.lit(None).cast(two.schema["r"].dataType).alias("found"))
    both = one.where("fits").unionByName(two, allowMissingColumns=True)
    at = F.col("at").asc() if back else F.col("at").desc()
    order = Window.partitionBy(*key_names).orderBy(at, "side", F.col("r").asc_nulls_first())
    found = F.last("r", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("found", found).where(F.col("l").isNotNull()).select("l", "found")
    out = out.union(alone) if outer else out.where(F.col("found").isNotNull())
    return out.select(F.col("l").alias(names[0]), F.col("found").alias(names[1]))


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high: right intervals are spread over bins of width, so the join has an equality to shuffle by."""
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    spread = right.where(F.col(low) < F.col(high)).withColumn("__bin", bins)
    placed = left.withColumn("__bin", F.floor(F.col(point) / width))
    return placed.join(spread, "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")
