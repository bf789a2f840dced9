"""Exact dedup by a log-structured merge index of digests (DataFrame functions only).

A batch of documents is flushed in memtables: each task sorts its entries (digest, a 64-bit hash, identifier, length) by digest
and writes them as one run. The batch is then merged to one entry per digest, sorted by ranges of digests: a run of level
0, with a bit filter of its digests. When a level holds FANOUT runs, compaction merges them to one run of the next level. An
entry keeps the member that stays (most code points, then the smallest identifier) and the number of members.

A later batch probes the runs: a run's filter keeps out most digests that the run doesn't hold, and only the rest are
joined with it. Entries move, about 70 bytes each, never texts; the merge combines on the map side, so a
digest that holds a third of all rows is one row per task.

Hits (digests with several members) are verified by bytes. Members whose 64-bit hashes differ are known to differ; for
the rest the least and the greatest text of each digest are compared, again combined on the map side. A bit filter of
the hits, on the 64-bit hash, keeps the texts of other documents out of that shuffle, and SHA-256 is taken of hits alone. If a
digest is not sound, its members are compared by whole text instead.

Defined cases: a null text counts as empty; all empty texts are one group; a null identifier comes after all others; of rows that
tie in length and identifier the one with the least 64-bit hash of its original text stays, of wholly equal rows
the one written first, so exactly one row of each group stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, carry, discard, materialize, pick, read, text_or_empty

#: Bits per entry of a filter, and its largest size (16 MB, broadcast). A full filter costs time, never results.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
FANOUT = 4


def normalized(c: Column) -> Column:
    for space in SPACE:
        c = F.replace(c, F.lit(space), F.lit(""))
    return c


def _digest(c: Column, digest_bits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digest_bits // 4)


def flush(docs: DataFrame, digest_bits: int = 256, batch: int = 0) -> DataFrame:
    """The entries of every row of docs, as a written table: one sorted run per task."""
    norm = normalized(text_or_empty())
    rows = docs.select(
        F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("hash"), F.col("doc_id"), F.char_length(text_or_empty()).alias("chars"),
        F.xxhash64("text").alias("spelling"), F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row"),
    )
    digest = F.col("sha") if digest_bits == 256 else F.substring("sha", 1, digest_bits // 4)
    return materialize(rows.sortWithinPartitions("sha").withColumn("digest", digest), "dedup-memtables")


def compact(entries: DataFrame, *keys: str) -> DataFrame:
    """One entry per key: the member that stays (best), the number of members, and the least and greatest hash."""
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "spelling", "batch", "row")
    return entries.groupBy(*keys).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"), F.min("hash").alias("low"), F.max("hash").alias("high"))


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"), F.min("low").alias("low"), F.max("high").alias("high"))


def bit_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of 4 KB of a column hash: bits / 32768 rows at most."""
    at = hashes.select(F.pmod("hash", F.lit(bits)).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def bits_for(entries: int, most: int = FILTER_MOST) -> int:
    return min(1 << max(15, (entries * FILTER_BITS).bit_length()), most)


def passing(rows: DataFrame, bitmaps: DataFrame, bits: int, negate: bool = False) -> DataFrame:
    """Rows whose column hash the filter may hold (or with negate: surely doesn't hold)."""
    names = rows.columns
    rows = rows.withColumn("__at", F.pmod("hash", F.lit(bits)))
    found = rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number("__at") == F.col("bucket"), "left")
    pos = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("getbit", byte, F.pmod(pos, F.lit(8)).cast("int")) == 1, F.lit(False))
    return found.where(~held if negate else held).select(*names)


class DigestIndex:
    """Batches in, marks out. levels[k] holds the runs of level k: (entries, filter, bits)."""

    def __init__(self, digest_bits: int = 256, fanout: int = FANOUT, filter_most: int = FILTER_MOST):
        self.digest_bits, self.fanout, self.filter_most = digest_bits, fanout, filter_most
        self.levels: list[list[tuple[DataFrame, DataFrame, int]]] = []
        self.batches: list[tuple[DataFrame, DataFrame]] = []  # documents and their entries

    def _run(self, entries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        run = materialize(entries.sortWithinPartitions("digest"), "dedup-run")
        bits = bits_for(run.count(), self.filter_most)
        return run, bit_filter(run.select(F.xxhash64("digest").alias("hash")), bits), bits

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, text); its digests as the index has them then: digest, best, group_size, low, high.

        Read the result before the next batch: compaction deletes the runs that it merges."""
        entries = flush(docs, self.digest_bits, len(self.batches))
        self.batches.append((docs, entries))
        new = self._run(compact(entries, "digest"))
        known = self.lookup(new[0])
        out = new[0] if known is None else materialize(_merged(new[0].unionByName(known)), "dedup-batch")
        self._place(0, new)
        return out

    def lookup(self, digests: DataFrame) -> DataFrame | None:
        """The entries that the runs hold for digests (column digest), one from each run that has it."""
        found = None
        for run, bitmaps, bits in (r for level in self.levels for r in level):
            asked = passing(digests.select("digest", F.xxhash64("digest").alias("hash")), bitmaps, bits).select("digest")
            hits = run.join(asked, "digest", "left_semi")
            found = hits if found is None else found.unionByName(hits)
        return found

    def _place(self, level: int, run: tuple) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs = [r[0] for r in self.levels[level]]
            together = runs[0]
            for r in runs[1:]:
                together = together.unionByName(r)
            self.levels[level] = []
            self._place(level + 1, self._run(_merged(together)))
            discard(*runs)

    def entries(self) -> DataFrame:
        """digest, best, group_size, low, high of every digest of all batches."""
        runs = [r[0] for level in self.levels for r in level]
        together = runs[0]
        for r in runs[1:]:
            together = together.unionByName(r)
        return together if len(runs) == 1 else _merged(together)

    def unsound(self, index: DataFrame) -> DataFrame:
        """Digests with members that are not all the same bytes."""
        hits = index.where("group_size > 1")
        split = hits.where("low <> high").select("digest")
        like = materialize(hits.where("low = high").select(F.col("low").alias("hash"), "digest"), "dedup-hits")
        bits = bits_for(like.count(), self.filter_most)
        bitmaps = bit_filter(like, bits)
        norm = normalized(text_or_empty())
        found = None
        for docs, _ in self.batches:
            rows = docs.select(norm.alias("norm")).select("norm", F.xxhash64("norm").alias("hash"))
            part = passing(rows, bitmaps, bits).select("norm", _digest(F.col("norm"), self.digest_bits).alias("digest"))
            found = part if found is None else found.unionByName(part)
        # A text that passes the filter by chance is a group of its own, or meets no hit.
        bad = found.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest")
        return split.union(bad.join(index.where("group_size > 1"), "digest", "left_semi")).distinct()

    def marks(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, sha, hash, spelling for every row of all batches."""
        index = materialize(self.entries(), "dedup-index")
        bad = materialize(self.unsound(index), "dedup-unsound")
        rows = self.batches[0][1]
        for _, more in self.batches[1:]:
            rows = rows.unionByName(more)
        joined = rows.join(index.select("digest", "best", "group_size"), "digest")
        if bad.limit(1).count():
            # Members of these digests differ in bytes: the whole text is the key for them.
            norm = normalized(text_or_empty())
            whole = None
            for docs, entries in self.batches:
                texts = docs.select("doc_id", norm.alias("norm"), F.xxhash64("text").alias("spelling")).withColumn("digest", _digest(F.col("norm"), self.digest_bits))
                texts = texts.join(bad, "digest", "left_semi").groupBy("doc_id", "spelling").agg(F.min("norm").alias("norm"))
                part = entries.join(bad, "digest", "left_semi").join(texts.withColumnRenamed("doc_id", "i").withColumnRenamed("spelling", "s"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("spelling") == F.col("s"))).drop("i", "s")
                whole = part if whole is None else whole.unionByName(part)
            whole = whole.join(compact(whole, "norm").select("norm", "best", "group_size"), "norm").drop("norm")
            joined = joined.join(bad, "digest", "left_anti").unionByName(whole.select(*joined.columns))
        kept = (F.col("batch") == F.col("best.batch")) & (F.col("row") == F.col("best.row"))
        return joined.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "sha", "hash", "spelling")


def _marked(docs: DataFrame, digest_bits: int = 256, filter_most: int = FILTER_MOST) -> DataFrame:
    index = DigestIndex(digest_bits, filter_most=filter_most)
    index.add(docs)
    return index.marks()


def exact_dedup(docs: DataFrame, digest_bits: int = 256, filter_most: int = FILTER_MOST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (columns doc_id and text)."""
    marks = _marked(pick(docs, "doc_id", "text"), digest_bits, filter_most)
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with its own columns, one row of each group of equal texts: what a pipeline stage keeps.

    Rows whose hash is that of no group with several members stay where they are; only the others are shuffled."""
    names = docs.columns
    docs = carry(docs, "hash", "__id", "__spelling", "__sha")
    marks = materialize(_marked(pick(docs, "doc_id", "text")).where("group_size > 1").select("doc_id", "kept", "sha", "hash", "spelling"), "dedup-marks")
    bits = bits_for(marks.count())
    bitmaps = bit_filter(marks, bits)
    rows = docs.withColumn("hash", F.xxhash64(normalized(text_or_empty())))
    alone = passing(rows, bitmaps, bits, negate=True).select(*docs.columns)
    hot = passing(rows, bitmaps, bits).withColumn("__sha", F.sha2(normalized(text_or_empty()), 256)).drop("hash")
    stay = marks.where("kept").select(F.col("doc_id").alias("__id"), F.col("spelling").alias("__spelling"), F.col("sha").alias("__s"))
    groups = hot.join(marks.select(F.col("sha").alias("__g")).distinct(), F.col("__sha") == F.col("__g"), "left_anti").drop("__sha")
    of_groups = hot.join(stay, (F.col("__sha") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__spelling")), "left_semi")
    return alone.unionByName(groups).unionByName(of_groups.dropDuplicates(["__sha"]).drop("__sha")).toDF(*names)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
