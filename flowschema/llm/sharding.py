"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass one scatters whole records into memory-sized buckets by a seeded hash of identifier and text; the number of
buckets follows the bytes of the input. Pass two puts each bucket into a canonical order, applies a seeded
Fisher-Yates shuffle to it (the built-in shuffle of an array) and numbers it on from the buckets before. The places
are cut into shards whose counts differ by one at most (law `rows`).

A record moves once. The bucket sizes are summed apart from the texts: one row per bucket. Equal rows share their
hash, so a bucket far larger than intended means many repeats of one row; then the scatter is salted.

Defined cases: a null text has 1 byte (its end) and the checksum 0; a null identifier is a value like others; repeated
rows keep their number; an empty table gives an empty result; shards may be empty if there are fewer rows than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carry, read, text_or_empty

BUCKET_BYTES = 16 << 20
SHARDS = 8
SEED = 20


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs with their columns, and shard (0 to shards - 1) and slot (from 0, gapless in each shard).

    Clashing columns of the input are renamed <name>_in. Columns of map type are not supported (they have no order)."""
    docs = carry(docs, "shard", "slot")
    size = F.octet_length(text_or_empty()) + 1
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    total, rows = docs.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(shards, -(-(total or 0) // bucket_bytes))

    def scattered(spread) -> tuple[DataFrame, DataFrame]:
        placed = docs.withColumn("__key", spread).withColumn("__bucket", F.pmod("__key", F.lit(buckets)))
        return placed, placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__bytes"))

    placed, counts = scattered(key)
    if (counts.agg(F.max("__bytes")).first()[0] or 0) > 8 * bucket_bytes:
        placed, counts = scattered(F.xxhash64(key, F.monotonically_increasing_id()))
    start = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__bucket", start.alias("__start"))
    record = F.struct("__key", *docs.columns)
    bucket = placed.repartition(buckets, "__bucket").groupBy("__bucket").agg(F.sort_array(F.collect_list(record)).alias("__rows"))
    # The random numbers depend on the partition and on the order in it: both are fixed by the number of the bucket,
    # as the shuffle comes before anything that might move the buckets again.
    bucket = bucket.sortWithinPartitions("__bucket").select("__bucket", F.shuffle("__rows", seed).alias("__rows"))
    out = bucket.join(starts, "__bucket").select("__start", F.posexplode("__rows").alias("__pos", "__row"))
    place = F.col("__start") + F.col("__pos")
    q, r = divmod(rows, shards)
    long_part = r * (q + 1)
    in_long = place < long_part
    rest = F.floor((place - long_part) / F.lit(max(q, 1)))
    shard = F.when(in_long, F.floor(place / F.lit(q + 1))).otherwise(r + rest).cast("int")
    slot = F.when(in_long, F.pmod(place, F.lit(q + 1))).otherwise(place - long_part - rest * q).cast("long")
    return out.select(*(F.col("__row")[c].alias(c) for c in docs.columns), shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the shuffled records as Parquet, one folder per shard, in the order of their slots."""
    out = shuffle_shards(docs, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
