"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules are (verdict, host suffix, path prefix); a rule fits its host and all subdomains, and the longest fitting rule wins.
Other URLs are judged by boosted trees on lexical features alone: lengths, depth, digit ratio, entropy, numbers of
parameters and hyphens, and statistics of the host's suffixes among the training URLs.

Labelled URLs: block if a part of the host is a word of the seed list, as block lists of hosts have them; allow if the host has none
and the document that the page renders (the number in its path) is marked as good and not toxic. Documents marked as bad
say nothing of their URL (README has the figures), so their URLs are not labelled unless by a seed. The trees never see the words of a host, so
what they learn from seeds must carry over to other hosts; the cut is the one with the best F1 on hosts that were held out.

Suffix statistics count all labelled URLs and their hosts below each suffix, in SUFFIX_BUCKETS hashed buckets. They don't look at the
labels, so a URL's own label can't speak for it. The trees are fitted on the driver on about 0.9 x TRAIN_ROWS different labelled
URLs, those whose hash lies below a threshold; every URL is judged.
Defined cases: a null url, or one without ://, has an empty host and path and is judged by the trees like others; without
seeds among the URLs nothing is blocked but by rules; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, pick, read

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEEDS = ("ads", "bets", "casino", "pills")
TRAIN_ROWS = 20_000
FOLDS = 5
SUFFIXES, SUFFIX_BUCKETS = 3, 1 << 14
TREES, DEPTH, RATE, CUTS = 40, 3, 0.15, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (like net/) and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> Column:
    """Hashed buckets of the last 1 to SUFFIXES parts of a host; -1 where it has fewer parts."""
    parts = F.size(F.split(host, "\\."))
    one = lambda k: F.when(parts >= k, F.pmod(F.xxhash64(F.substring_index(host, ".", -k)), F.lit(SUFFIX_BUCKETS)).cast("int")).otherwise(-1)
    return F.array(*(one(k) for k in range(1, SUFFIXES + 1)))


def described(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with what the features need besides: query, longest part of the host, suffix buckets."""
    query = F.coalesce(F.regexp_extract(F.regexp_extract("url", r"^([^#]*)", 1), r"\?(.*)$", 1), F.lit(""))
    longest = F.array_max(F.transform(F.split("host", "[.-]"), lambda x: F.length(x)))
    return urls.withColumn("query", query).withColumn("longest", longest).withColumn("suffixes", suffixes(F.col("host")))


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Counts of the byte values of each text: rows x 256."""
    texts = column.fill_null("").cast(pa.binary())
    size = np.asarray(pa.compute.binary_length(texts)).astype(np.int64)
    joined = np.frombuffer(b"".join(texts.to_pylist()), dtype=np.uint8)
    row = np.repeat(np.arange(len(texts)), size)
    return np.bincount(row * 256 + joined, minlength=256 * len(texts)).reshape(-1, 256)


def features(table: pa.RecordBatch | pa.Table, statistics: Suffixes) -> np.ndarray:
    """Features of described URLs."""
    one = lambda c: x.combine_chunks() if isinstance(x := table.column(c), pa.ChunkedArray) else x
    url, host, path, query = (_bytes_of(one(c)) for c in ("url", "host", "path", "query"))
    count = lambda t, chars: t[:, list(chars)].sum(1)
    n = np.maximum(url.sum(1), 1)
    share = url / n[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    digits = b"0123456789"
    ends = np.array([(p or "").endswith("/") for p in one("path").to_pylist()], dtype=float)
    secure = np.array([(u or "").startswith("https") for u in one("url").to_pylist()], dtype=float)
    return np.column_stack([
        url.sum(1), host.sum(1), path.sum(1), count(path, b"/"), count(host, b"."), count(url, digits) / n, count(host, digits) / np.maximum(host.sum(1), 1), entropy,
        count(query, b"&") + (query.sum(1) > 0), count(query, b"="), query.sum(1), count(url, b"#") > 0, count(host, b"-"), count(path, b"-_"), secure,
        np.asarray(one("longest").fill_null(0)), ends, count(path, b"."), count(url, b"%@~!$*'"), statistics.of(table),
    ]).astype(float)


class Suffixes:
    """Labelled URLs and their different hosts below each suffix bucket; the last bucket is that of missing suffixes, always empty."""

    def __init__(self, rows: pa.Table | None = None):
        self.seen = np.zeros((2, SUFFIX_BUCKETS + 1))
        if rows is not None and len(rows):
            self.seen[:, rows.column("bucket").to_numpy()] = rows.column("urls").to_numpy(), rows.column("hosts").to_numpy()

    def of(self, table: pa.RecordBatch | pa.Table) -> np.ndarray:
        column = table.column("suffixes")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        at = column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), SUFFIXES)
        return np.log1p(np.hstack(self.seen[:, at]))


class Boosted:
    """Gradient-boosted regression trees for log-odds, on values cut at quantiles."""

    def __init__(self) -> None:
        self.trees: list[list[tuple]] = []
        self.bias = -10.0
        self.cut = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
        bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        score = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._run(tree, x)
        return self

    def _grow(self, bins: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
        leaf = float(-RATE * g[at].sum() / (h[at].sum() + 1.0))
        if depth == 0 or len(at) < 40:
            return leaf
        best, gs, hs = (1.0, None, None), g[at].sum(), h[at].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(bins[at, f], weights=g[at], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins[at, f], weights=h[at], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(hl < 5) | (hs - hl < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            return leaf
        left = bins[at, f] <= k
        return f, float(cuts[f][k]), self._grow(bins, cuts, g, h, at[left], depth - 1), self._grow(bins, cuts, g, h, at[~left], depth - 1)

    def _run(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._run(low, x), self._run(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for t in self.trees:
            score += self._run(t, x)
        return 1 / (1 + np.exp(-score))


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut (block at or above it) with the best F1, half way to the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)  # a cut can't part equal scores
    f1 = np.where(last, 2 * hit / (np.arange(1, len(s) + 1) + y.sum()), -1)
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


class Judge:
    """The fitted filter: trees, suffix statistics, and the scores and labels of hosts held out."""

    def __init__(self) -> None:
        self.model, self.suffixes = Boosted(), Suffixes()
        self.held_out: tuple[np.ndarray, np.ndarray] = np.zeros(0), np.zeros(0)

    def probability(self, table: pa.RecordBatch | pa.Table) -> np.ndarray:
        return self.model.probability(features(table, self.suffixes))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Judge:
    """Fit on URLs (url, host, path, label 1 for block): counts of all of them, trees on a bounded share of the different ones."""
    out = Judge()
    distinct = described(labelled.groupBy("url", "host", "path").agg(F.max("label").alias("label")))
    fold = F.pmod(F.xxhash64(F.substring_index("host", ".", -SUFFIXES)), F.lit(FOLDS)).cast("int")
    distinct = materialize(distinct.withColumn("fold", fold), "url-labels")
    below = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.first("suffixes").alias("suffixes")).select("urls", F.explode("suffixes").alias("bucket"))
    counts = below.where("bucket >= 0").groupBy("bucket").agg(F.sum("urls").cast("double").alias("urls"), F.count(F.lit(1)).cast("double").alias("hosts"))
    out.suffixes = Suffixes(counts.toArrow())  # SUFFIX_BUCKETS rows at most
    n, blocked = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not blocked:
        discard(distinct)
        return out
    # A share of the hash space that holds 0.9 x rows URLs on average, far from the bound: they are different URLs.
    span = 1 << 40
    sample = distinct.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(span)) < F.lit(int(span * min(1.0, 0.9 * rows / n)))).toArrow()
    discard(distinct)
    sample = sample.sort_by("url")
    y, of = sample.column("label").to_numpy().astype(float), sample.column("fold").to_numpy()
    x = features(sample, out.suffixes)
    held, known = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for f in set(of[:].tolist()):
        rest = of != f
        if 0 < y[rest].sum() < rest.sum():
            held[~rest] = Boosted().fit(x[rest], y[rest]).probability(x[~rest])
            known[~rest] = True
    out.model.fit(x, y)
    out.held_out = held[known], y[known]
    if 0 < y[known].sum() < known.sum():
        out.model.cut = best_cut(*out.held_out)
    return out


def labelled_urls(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """url, host, path, label of the pages that a seed or a good document labels."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url", host.alias("host"), path.alias("path"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)")
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marks = pick(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min(good.cast("int")).alias("good")).where("good = 1")
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    urls = urls.withColumn("seeded", seeded)
    allowed = urls.where(~F.col("seeded")).withColumn("doc", number).join(marks, "doc", "left_semi")
    return urls.where("seeded").select("url", "host", "path", F.lit(1).alias("label")).union(allowed.select("url", "host", "path", F.lit(0)))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, seeds: tuple[str, ...] = SEEDS, rows: int = TRAIN_ROWS, filter_: Judge | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block) for every row of pages (page_id, url)."""
    pages = pick(pages, "page_id", "url")
    fitted = filter_ or train(labelled_urls(pages, labels, seeds), rows)
    kind = pages.schema["page_id"].dataType.simpleString()
    kept = ("page_id", "host", "path", "rule", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fitted.probability(b) if len(b) else [], pa.float64())], names=[*kept, "score"])

    host, path = host_and_path(F.col("url"))
    urls = described(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    name, fixed = rule_of(F.col("host"), F.col("path"), rules)
    scored = urls.withColumn("rule", name).withColumn("fixed", fixed).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, fixed string, score double")
    verdict = F.coalesce("fixed", F.when(F.col("score") >= fitted.model.cut, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
