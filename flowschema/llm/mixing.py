"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and by the leading bits of a hash of the identifier. In each source's cumulated histogram
the bucket where the budget ends is found; only the rows of that boundary bucket are summed again by the next bits
(nested budget thresholds) until the bits are used up or no boundary is left. Documents are then filtered by comparing
their hash with the threshold of their source; nothing is sorted. A histogram has at most 1024 rows per source and
level and is combined on the map side, so a source with a third of all rows is no larger than the others.

A source whose target is q times its size and a rest: every document is taken q times, and those below the threshold
once more; the threshold is the one whose sum is nearest to the rest.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with the same
identifier share their hash and are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carry, materialize, pick, read, word_count

BITS = 60
STEP = 10
WEIGHTS = (5, 2, 1)
LIMIT = 3


def id_hash(name: str = "doc_id") -> Column:
    """60 bits of the MD5 of the identifier as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(name).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """target of each source (one row each: source, source_size): shares by weight, stopped at limit times its size.

    Sharing the excess again by weight until no source is above its stop is a water level: min(stop, level x weight).
    Sources are ordered by stop / weight; level follows from the sums of those already full."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(limit)))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    t = t.withColumn("level", left / heavy).withColumn("nth", F.row_number().over(line))
    # All before the first source that the level doesn't fill are full; its level holds for it and all after it.
    open_at = F.when(F.col("stop") > F.col("level") * F.col("weight"), F.struct("nth", "level"))
    t = t.withColumn("first", F.min(open_at).over(every))
    full = F.col("first").isNull() | (F.col("nth") < F.col("first.nth"))
    return t.select("source", "source_size", F.when(full, F.col("stop")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies of every document), threshold (hash below: one more)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals, weights, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # low: hashes below it are taken; taken: their sum; the boundary bucket begins at low.
    state = materialize(plan.withColumn("low", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long")), "mix-plan")
    keyed = sizes.where("size > 0").select(F.col("source").alias("s"), "size", "hash")
    for shift in range(BITS - STEP, -1, -STEP):
        span = 1 << (shift + STEP)
        rows = keyed.join(state.where("rest > 0").select("source", "low"), F.col("s").eqNullSafe(F.col("source")))
        rows = rows.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(span)))
        hist = rows.groupBy("s", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        cum = Window.partitionBy("s").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(cum))
        # The boundary: the first bucket that the rest of the budget doesn't hold whole.
        first = hist.join(state.select("source", "rest", "taken"), F.col("s").eqNullSafe(F.col("source"))).where(F.col("upto") + F.col("taken") > F.col("rest"))
        first = first.groupBy("s").agg(F.min(F.struct("bucket", "upto", "n", "rows")).alias("b"))
        moved = state.join(first, F.col("s").eqNullSafe(F.col("source")), "left")
        low = F.shiftleft(F.col("b.bucket"), shift)
        before = F.col("taken") + F.col("b.upto") - F.col("b.n")
        if shift == 0:
            # All bits are used: the boundary is one hash; it is taken if that comes nearer.
            nearer = before + F.col("taken") + F.col("b.upto") < 2 * F.col("rest")
            low, before = low + nearer.cast("long"), F.when(nearer, F.col("taken") + F.col("b.upto")).otherwise(before)
        found = F.col("b").isNotNull()
        no_edge = F.lit(1 << BITS) if shift == BITS - STEP else F.col("low")  # the rest holds every row
        state = materialize(moved.select("source", "source_size", "target", "whole", "rest", F.when(found, low).otherwise(no_edge).alias("low"), F.when(found, before).otherwise(F.col("taken")).alias("taken")), "mix-plan")
    return state.select("source", "source_size", "target", "whole", F.when(F.col("rest") > 0, F.col("low")).otherwise(F.lit(0)).alias("threshold"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash of every row, as a written table: texts are read once."""
    rows = pick(docs, "doc_id", "text", "source")
    return materialize(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash().alias("hash")), "mix-sizes")


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, hash, ...) with the plan of their source and copies: how often the mix takes them."""
    p = plan.withColumnRenamed("source", "__source")
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.withColumn("copies", F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    sizes = sizes_of(docs)
    rows = copies(sizes, plan_mix(sizes, weights, limit))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mix itself: docs with its own columns, each row as often as it is taken. Rows of size 0 are taken like others."""
    names = docs.columns
    plan = plan_mix(sizes_of(docs), weights, limit)
    docs = carry(docs, "source_size", "target", "whole", "threshold", "copies", "hash")
    rows = copies(docs.withColumn("hash", id_hash()), plan).where("copies > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = rows.select(*docs.columns)
    return out.toDF(*names)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::DOUBLE AS weight,
             source_size * 3.0::DOUBLE AS stop FROM s),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, row_number() OVER (ORDER BY stop / weight, source IS NULL, source) AS nth FROM c),
f AS (SELECT *, min(CASE WHEN stop > level * weight THEN nth END) OVER () AS first_open FROM o),
t AS (SELECT source, source_size,
             CASE WHEN first_open IS NULL OR nth < first_open THEN stop
                  ELSE (max(CASE WHEN nth = first_open THEN level END) OVER ()) * weight END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
j AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, min(h) FILTER (WHERE size > 0 AND upto > rest) AS edge FROM j GROUP BY source),
n AS (SELECT j.source, bool_or(upto - same + upto < 2 * rest) AS nearer
      FROM j JOIN e ON j.source IS NOT DISTINCT FROM e.source AND j.h = e.edge GROUP BY j.source)
SELECT j.doc_id, j.size, j.source_size::BIGINT AS source_size, round(j.target, 6) AS target,
       (j.size * (j.whole + CASE WHEN j.rest > 0 AND (j.h < e.edge OR (j.h = e.edge AND n.nearer)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j JOIN e ON j.source IS NOT DISTINCT FROM e.source
LEFT JOIN n ON j.source IS NOT DISTINCT FROM n.source
"""
