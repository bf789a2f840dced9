"""Connected components of an edge table, by alternating large-star and small-star steps (DataFrame functions only).

Each step groups by node, takes a minimum (combined on the map side) and joins it back; the edge table is written to the
shared folder after each round. Rounds grow with the logarithm of the number of nodes. A hub is a skewed
join key at most, which adaptive execution splits; no neighbour list is ever collected.

Every round is several plans, and the driver keeps what it knows of each plan that ran. So callers that ask often may let
one task find the components of up to at_once links between integers, which gives the same result in three plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links that one task may hold: 16 MB of them, and about 100 MB at work.
AT_ONCE = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a, b, and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task to nodes and roots."""
    parts = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches if len(x)]
    if parts:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _roots(*map(np.concatenate, zip(*parts))))), names=["node", "root"])


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """node, root for every node of edges (columns a, b of one orderable type); root is the smallest node reachable."""
    rows = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    kind = rows.schema["a"].dataType.simpleString()
    if at_once and kind in ("int", "bigint") and rows.count() <= at_once:
        found = materialize(rows.coalesce(1).mapInArrow(_whole, f"node {kind}, root {kind}"), "components")
        discard(rows)
        return found
    seen = None
    while True:
        # Large star: every neighbour above a node is linked to the least neighbour.
        both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below are linked to the least of them.
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        near = large.join(least, F.col("a") == F.col("n"))
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m")).distinct()
        after = materialize(small, "links")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(rows)
        rows = after
        if now == seen:
            break
        seen = now
    roots = rows.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
