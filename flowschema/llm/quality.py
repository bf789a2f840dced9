"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

One pass over the texts reduces each document to a few statistics of its whole text (shares of character classes, word
and line lengths, repetition, function words); they are written as a narrow table, and all later steps read that.
Random Fourier features approximate a Gaussian kernel over the standardised statistics. Each task sums its part of the
normal equations; the parts are summed on in a fixed number of streams, so the driver gets at most 32 blocks of
fixed size. Scores of the training rows are counted in fixed bins, and pool-adjacent-violators turns these into a
monotone map from score to probability.

Identifiers, languages, sources and labels are never inputs of a score. Defined cases: a null text counts as empty and
gets a score like any text; labels that are null are not learned from; contradicting labels of one identifier are
averaged; without any training rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, carry, discard, id_crc, materialize, pick, read
from .exact_dedup import bit_filter, bits_for, passing

FEATURES = 256  # random Fourier features
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1e-3  # per training row
BINS = 2000
STREAMS = 32
SEED = 10
CUT = 0.3

_CLASSES = np.zeros(256, dtype=np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*+=<>@^~_\\", b"\"'()-:;/[]{}`", bytes(range(128, 256))), 1):
    _CLASSES[list(_set)] = _i
_KINDS = 13
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,!?|#$%&*+=<>@^~;:")] = True
_SMALL = frozenset("the of and to in is that was for on with as are it be by der die das und ist in den von zu mit la le les de des et est en un une que el los las y se por con del su para".encode().split())
N_STATS = _KINDS + 17


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    b = np.frombuffer(raw, dtype=np.uint8)
    out = np.zeros(N_STATS)
    if not len(b):
        return out
    counts = np.bincount(b, minlength=256)
    out[:_KINDS] = np.bincount(_CLASSES, weights=counts, minlength=_KINDS) / len(b)
    p = counts[counts > 0] / len(b)
    words = WORD_BYTES.findall(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = _KINDS
    out[k] = np.log1p(len(b))
    out[k + 1] = -(p * np.log2(p)).sum()
    if words:
        n = len(words)
        length = np.fromiter(map(len, words), dtype=np.float64, count=n)
        distinct = set(words)
        ends = np.frombuffer(bytes(w[-1] for w in words), dtype=np.uint8)
        first = np.frombuffer(bytes(w[0] for w in words), dtype=np.uint8)
        pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
        out[k + 2 : k + 13] = (
            np.log1p(n), length.mean(), length.std(), min(length.max(), 100.0), len(distinct) / n, np.log1p(len(distinct)) / np.log1p(n),
            pairs / max(n - 1, 1), _ENDS[ends].mean(), ((first >= 65) & (first <= 90)).mean(), sum(w in _SMALL for w in words) / n, sum(w.isupper() for w in words) / n,
        )
    if lines:
        size = np.fromiter(map(len, lines), dtype=np.float64, count=len(lines))
        out[k + 13 : k + 17] = (np.log1p(len(lines)), np.log1p(size.mean()), len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / len(lines))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, N_STATS)
        rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        flat = pa.array(x.ravel())
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([*rest, stats], names=[*names, "stats"])


def measured(docs: DataFrame) -> DataFrame:
    """The columns of docs but the text, and the statistics of the whole text, as a written table."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return materialize(docs.mapInArrow(_measure, f"{kinds}, stats array<double>"), "quality-stats")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


class Model:
    """Weights of the fitted classifier; scores arrays of statistics."""

    def __init__(self, n_stats: int = N_STATS, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n_stats), np.ones(n_stats)
        self.w = rng.normal(size=(n_stats, features)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.coef: np.ndarray | None = None
        self.low, self.high = 0.0, 1.0
        self.curve = np.full(BINS, 0.5)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Constant, standardised statistics, random Fourier features."""
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(s @ self.w + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([np.ones((len(x), 1)), z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.coef if self.coef is not None else np.zeros(len(x))

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip((self.raw(x) - self.low) / (self.high - self.low) * BINS - 0.5, 0, BINS - 1)
        return np.clip(np.interp(at, np.arange(BINS), self.curve), 0.0, 1.0)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over bins; empty bins take the line between their neighbours."""
    at = np.nonzero(weight)[0]
    if not len(at):
        return np.full(len(weight), 0.5)
    blocks: list[list[float]] = []
    for i in at:
        blocks.append([value[i], weight[i], 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v, w, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + w, blocks[-1][2] + n]
    fitted = np.repeat([v / w for v, w, _ in blocks], [n for *_, n in blocks])
    return np.interp(np.arange(len(weight)), at, fitted)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all rows of part(x, y), an array of fixed size: summed in each task, then in STREAMS streams."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows, key = np.zeros(size), False, 0
        for b in batches:
            if len(b):
                y = b.column("label").to_numpy(zero_copy_only=False)
                key = (key + int(np.abs(y).sum()) + len(y)) % STREAMS
                total += part(_matrix(b, "stats"), y)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column("block"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_pydict({"block": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", "label").mapInArrow(within, "key int, block binary")
    blocks = parts.repartition(STREAMS, "key").mapInArrow(across, "block binary").collect()
    return sum((np.frombuffer(b.block) for b in blocks), np.zeros(size))


def fit(train: DataFrame) -> Model:
    """Fit on rows of stats array<double>, label double: all of them, by sums of fixed size."""
    model, d = Model(), N_STATS
    total = _summed(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = total[0]
    if not n:
        return model
    model.mean = total[1 : 1 + d] / n
    model.scale = np.sqrt(np.maximum(total[1 + d :] / n - model.mean**2, 1e-8))
    m = 1 + FEATURES

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lift(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(train, normal, m * m + m)
    gram = sums[: m * m].reshape(m, m) + np.diag([1e-9] + [RIDGE * n / FEATURES] * FEATURES)
    model.coef = np.linalg.solve(gram, sums[m * m :])
    model.low, model.high = -0.5, 1.5

    def counted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = model.bins(model.raw(x))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    counts = _summed(train, counted, 2 * BINS)
    model.curve = isotonic(counts[:BINS], counts[BINS:])
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b, "stats")) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def training_labels(labels: DataFrame) -> DataFrame:
    """label_id, label: the mean of the quality marks of an identifier, without nulls."""
    rows = pick(labels, "doc_id", "quality").where("quality is not null")
    return rows.groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; learned from rows whose crc32(doc_id) mod folds is not 0."""
    stats = measured(pick(docs, "doc_id", "text"))
    held = F.pmod(id_crc(), F.lit(folds)) == 0
    marks = training_labels(labels)
    train = stats.where(~held).join(marks, F.col("doc_id") == F.col("label_id")).select("stats", "label")
    model = fit(materialize(train, "quality-train"))
    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(_scorer(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs with its own columns, without the rows that the classifier rejects: what a pipeline stage keeps.

    A score depends on the text alone, so rejected texts are known by 128 bits of hash. Rows whose hash a filter of those doesn't hold
    stay where they are; only the others are shuffled."""
    names = docs.columns
    docs = carry(docs, "hash", "more")
    hashes = {"hash": F.xxhash64("text"), "more": F.xxhash64(F.lit(SEED), "text")}
    stats = measured(pick(docs, "doc_id", "text").withColumns(hashes))
    marks = training_labels(labels)
    train = stats.where(F.pmod(id_crc(), F.lit(5)) != 0).join(marks, F.col("doc_id") == F.col("label_id")).select("stats", "label")
    train = materialize(train, "quality-train")
    model = fit(train)

    def reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield b.select(["hash", "more"]).filter(pa.array(model.score(_matrix(b, "stats")) < cut))

    rejected = materialize(stats.select("hash", "more", "stats").mapInArrow(reject, "hash long, more long").distinct(), "quality-rejected")
    discard(train, stats)
    bits = bits_for(rejected.count())
    bitmaps = bit_filter(rejected, bits)
    rows = docs.withColumns(hashes)
    sure, other = passing(rows, bitmaps, bits, negate=True), passing(rows, bitmaps, bits)
    other = other.join(rejected, ["hash", "more"], "left_anti").select(*rows.columns)
    return sure.unionByName(other).select(*docs.columns).toDF(*names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
