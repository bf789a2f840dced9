"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are normalised in double precision; cosine >= t is Euclidean distance <= sqrt(2 - 2t). Equal vectors are one
class with a weight. The top level of the tree is a net of pivots from a bounded sample (PIVOTS at most); every class goes to
the nearest pivot, and cells of more than CELL classes are split by hash. Each cell is a cover tree of its own: nested
nets with halving radii, every child with its exact covering radius. Pairs of cells, then pairs of nodes, are pruned when
the distance of their centres exceeds both covering radii and the threshold. Children of a node are compared as one
matrix, so a level that cannot prune costs a matrix product and no more.

A pair of cells reports the weight linked to each class and a spanning forest of its links, never all pairs. Where the
data have no metric structure (random directions) no cell pair can be pruned, and the work grows with the square of
the number of vectors; that is inherent to exact threshold pairs by covering radii.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null vec_id,
link with nothing; vectors of different lengths do not link; rows that repeat a vector are other vectors to each other;
an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, pick, read
from .graph import components

COSINE = 0.95
CELL = 4096
PIVOTS = 1024
SLACK = 1e-6  # added to every bound: pruning must not depend on rounding
_ROWS = 512
GROUP = 4
#: Radius of a cell's first net. Wider nodes than about twice the threshold's reach are rarely pruned against each other.
TOP = 0.5


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaling by the largest component first keeps squares of any finite vector inside double range."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def build(x: np.ndarray, at: np.ndarray | None = None, radius: float = 1.0) -> dict:
    """A node over the points at: centres (indices), covering radii, and nodes below those that cover more than their centre."""
    at = np.arange(len(x)) if at is None else at
    near = np.empty((len(at), len(at)), dtype=np.float32)
    for i in range(0, len(at), _ROWS):
        near[i : i + _ROWS] = _distance(x[at[i : i + _ROWS]], x[at])
    owner = np.full(len(at), -1)
    for i in range(len(at)):  # greedy net: the first point without a centre becomes one
        if owner[i] < 0:
            owner[(near[i] <= radius) & (owner < 0)] = i
            owner[i] = i
    assert (owner >= 0).all(), "a point without a centre would be lost"
    centres = np.unique(owner)
    node = {"c": at[centres], "r": np.zeros(len(centres)), "k": {}}
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], centres)
    for k, (c, i, j) in enumerate(zip(centres, cut, [*cut[1:], len(order)])):
        if j - i > 1:
            mine = order[i:j]
            node["r"][k] = float(near[c, mine].max()) + SLACK
            if radius > 1e-4:
                node["k"][k] = build(x, at[mine], min(radius, node["r"][k]) / 2)
            else:  # points this close are told apart as single points
                node["k"][k] = {"c": at[mine], "r": np.zeros(len(mine)), "k": {}}
    return node


def _single(i: int) -> dict:
    return {"c": np.array([i]), "r": np.zeros(1), "k": {}}


def dual(a: dict, x: np.ndarray, b: dict, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of x, j of y) with cosine >= the threshold, each once (both orders if the trees are the same)."""
    reach = np.sqrt(2.0 - 2.0 * cosine) + SLACK
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    stack = [(a, b)]

    def below(p: dict, q: dict, i: np.ndarray, j: np.ndarray) -> None:
        """Push the pairs of children i, j (at least one of them covers more than its centre) that the bound doesn't prune."""
        for s in range(0, len(i), _ROWS):
            rows = i[s : s + _ROWS]
            far = _distance(x[p["c"][rows]], y[q["c"][j]])
            m, n = np.nonzero(far <= p["r"][rows, None] + q["r"][None, j] + reach)
            stack.extend((p["k"].get(u) or _single(p["c"][u]), q["k"].get(v) or _single(q["c"][v])) for u, v in zip(rows[m].tolist(), j[n].tolist()))

    while stack:
        p, q = stack.pop()
        lone_p, lone_q = np.nonzero(p["r"] == 0)[0], np.nonzero(q["r"] == 0)[0]
        wide_p, wide_q = np.nonzero(p["r"])[0], np.nonzero(q["r"])[0]
        cp, cq = p["c"][lone_p], q["c"][lone_q]
        # Single points against single points: single precision finds candidates, double precision decides.
        for s in range(0, len(cp) if len(cq) else 0, _ROWS):
            i, j = np.nonzero(x32[cp[s : s + _ROWS]] @ y32[cq].T >= cosine - 1e-5)
            i, j = cp[i + s], cq[j]
            sure = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            if sure.any():
                yield i[sure], j[sure]
        if len(wide_p):
            below(p, q, wide_p, np.arange(len(q["c"])))
        if len(wide_q) and len(lone_p):
            below(p, q, lone_p, wide_q)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the classes of i and j: labels are indices of smaller members."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label[:] = label[label]
        if (label == before).all():
            return


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Single precision where it holds the same values."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if np.array_equal(y, x) else x


def _grown(table: pa.Table) -> pa.Table:
    """One cell to its cover tree."""
    table = table.combine_chunks()
    raw = np.array(table.column("vec").to_pylist(), dtype=np.float64)
    tree = build(_unit(raw), radius=TOP)
    blob = pickle.dumps((table.column("cid").to_numpy(), table.column("w").to_numpy(), _narrow(raw), tree))
    far = max(x for x in table.column("far").to_pylist())
    return pa.table({"p": table.column("p").slice(0, 1), "sub": table.column("sub").slice(0, 1), "far": pa.array([far]), "tree": pa.array([blob], pa.binary())})


def _compared(cosine: float):
    """The cells of two groups and the pairs of them that meet to rows (a, null, linked weight) and (a, b, null), b a link of a spanning forest."""

    def pair(one: tuple, two: tuple, same: bool) -> Iterator[pa.Table]:
        (ids, w, x, tree), (ids2, w2, y, tree2) = one, two
        n = len(ids)
        total, total2 = np.zeros(n, np.int64), np.zeros(len(ids2), np.int64)
        label = np.arange(n if same else n + len(ids2))
        for i, j in dual(tree, x, tree2, y, cosine):
            if same:
                i, j = i[i != j], j[i != j]
            np.add.at(total, i, w2[j])
            if not same:
                np.add.at(total2, j, w[i])
            _join(label, i, j if same else j + n)
        every = ids if same else np.concatenate([ids, ids2])
        tied = np.nonzero(label != np.arange(len(label)))[0]
        for own, t in ((ids, total),) if same else ((ids, total), (ids2, total2)):
            at = np.nonzero(t)[0]
            yield pa.table({"a": pa.array(own[at], pa.int64()), "b": pa.nulls(len(at), pa.int64()), "n": pa.array(t[at])})
        yield pa.table({"a": pa.array(every[tied], pa.int64()), "b": pa.array(every[label[tied]], pa.int64()), "n": pa.nulls(len(tied), pa.int64())})

    def run(cells: pa.Table, pairs: pa.Table) -> pa.Table:
        found = {}
        for p, sub, blob in zip(*(cells.column(c) for c in ("p", "sub", "tree"))):
            ids, w, raw, tree = pickle.loads(blob.as_buffer().to_pybytes())
            found[p.as_py(), sub.as_py()] = ids, w, _unit(raw), tree
        out = [pa.table({"a": pa.nulls(0, pa.int64()), "b": pa.nulls(0, pa.int64()), "n": pa.nulls(0, pa.int64())})]
        for r in pairs.to_pylist():
            one, two = (r["pa"], r["sa"]), (r["pb"], r["sb"])
            out += pair(found[one], found[two], one == two)
        return pa.concat_tables(out)

    return run


def near_vectors(table: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding)."""
    spark = table.sparkSession
    rows = pick(table, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("vec", lambda v: v != 0), F.lit(False))
    classes = rows.where(good).groupBy("vec").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("w"))
    classes = materialize(classes, "vectors")
    n = classes.count()
    dims = classes.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    main = dims.d if dims else 0
    # Pivots: a bounded sample, those with the smallest hash, and of it the points that a greedy net takes first.
    wanted = min(max(n // cell, 1), PIVOTS)
    sample = classes.where(F.size("vec") == main).orderBy(F.xxhash64("cid"), "cid").select("vec").limit(wanted).toArrow().column("vec").to_pylist() if n else []
    pivots = spark.sparkContext.broadcast(_unit(np.array(sample, dtype=np.float64)) if sample else np.zeros((0, 1)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piv = pivots.value
        for b in batches:
            if not len(b):
                continue
            vec = b.column("vec")
            size = np.asarray(vec.value_lengths())
            p, far = -size.astype(np.int32), np.full(len(b), 3.0)
            mine = np.nonzero(size == piv.shape[1])[0]
            if len(mine):
                d = _distance(_unit(_vectors(vec.take(pa.array(mine)))), piv)
                p[mine] = d.argmin(axis=1)
                far[mine] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.int32()), pa.array(far)], names=[*b.schema.names, "p", "far"])

    placed = materialize(classes.mapInArrow(assigned, "vec array<double>, cid long, w long, p int, far double"), "placed")
    parts = placed.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / cell).alias("parts"))  # PIVOTS rows, and one per other length
    cells = placed.join(parts, "p").withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts")
    trees = materialize(cells.groupBy("p", "sub").applyInArrow(_grown, "p int, sub int, far double, tree binary"), "trees")
    d = _distance(pivots.value, pivots.value)
    near = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(sample)) for j in range(i, len(sample))], "pa int, pb int, d double")
    others = trees.where("p < 0").select(F.col("p").alias("pa"), F.col("p").alias("pb"), F.lit(0.0).alias("d")).distinct()
    one = trees.select(F.col("p").alias("pa"), F.col("sub").alias("sa"), F.col("far").alias("ra"))
    two = trees.select(F.col("p").alias("pb"), F.col("sub").alias("sb"), F.col("far").alias("rb"))
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + 2 * SLACK
    pairs = near.union(others).join(one, "pa").join(two, "pb").where((F.col("d") <= F.col("ra") + F.col("rb") + reach) & ((F.col("pa") < F.col("pb")) | (F.col("sa") <= F.col("sb"))))
    pairs = materialize(pairs.select("pa", "sa", "pb", "sb"), "cell-pairs")
    # Groups of GROUP cells meet in one task, so a tree goes to as many tasks as there are groups near it, not cells. One row per cell here.
    nth = F.row_number().over(Window.orderBy("p", "sub"))
    groups = trees.select("p", "sub", F.floor((nth - 1) / GROUP).cast("long").alias("g"))
    meet = pairs.join(groups.toDF("pa", "sa", "ga"), ["pa", "sa"]).join(groups.toDF("pb", "sb", "gb"), ["pb", "sb"])
    meet = materialize(meet.select("ga", "gb", "pa", "sa", "pb", "sb"), "cell-meetings")
    sent = meet.select("ga", "gb", F.explode(F.array(F.struct(F.col("pa").alias("p"), F.col("sa").alias("sub")), F.struct(F.col("pb").alias("p"), F.col("sb").alias("sub")))).alias("c")).distinct()
    sent = sent.select("ga", "gb", "c.p", "c.sub").join(trees.select("p", "sub", "tree"), ["p", "sub"]).select("ga", "gb", "p", "sub", "tree")
    sent = sent.toDF("ga1", "gb1", "p", "sub", "tree")
    tasks = max(1, meet.select("ga", "gb").distinct().count())
    both = sent.repartition(tasks, "ga1", "gb1").groupBy("ga1", "gb1").cogroup(meet.repartition(tasks, "ga", "gb").groupBy("ga", "gb"))
    found = materialize(both.applyInArrow(_compared(cosine), "a long, b long, n long"), "vector-links")
    discard(placed, trees, pairs, meet)
    linked = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = classes.join(linked, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    known = known.select(F.col("vec").alias("v"), (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component"))
    out = rows.withColumn("v_in", F.when(good, F.col("vec"))).join(known, F.col("v_in") == F.col("v"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
