"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: the majority of the bits of the XXH64 of every word shingle of the whole text.

Covering: each of the 64 bits gets a nonzero vector of r + 1 bits; table v (v nonzero) keeps the bits whose vector has
odd inner product with v. For any r differing bits there is a v orthogonal to all their vectors, so a pair within
radius r agrees on all bits of some table: no pair is missed. For r = 3 there are 15 tables of 32 to 36 bits.

Only distinct fingerprints enter the tables, 16 bytes a row. A bucket with more than BUCKET members is not compared:
its members go on to tables over the bits that are still free (30, then 14, then 6), where the same covering holds;
as fingerprints in it are distinct, three levels bound every bucket by BUCKET. Inside a bucket a breadth-first walk yields
a spanning forest of the links, so a bucket emits fewer links than members. Components are found on those links.

Groups of near copies (keep_originals, the pipeline's stage) are pairs of similarity 0.8 or more of five-word shingle sets. Sets whose
fingerprints lie within the radius are found first, by the covering tables, and verified on whole sets. At 0.8 fingerprints
differ in about 10 of 64 bits, far beyond any radius that covering masks can serve. So prefix filtering, which misses
none, finds the rest: sets that share a shingle of their prefixes and that fingerprints have not brought together.

Defined cases: a null text counts as empty; texts without words have fingerprint zero; fewer words than a
shingle make one shingle; a null identifier is larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTES, carry, discard, give_back, materialize, pick, read, slices
from .exact_dedup import bit_filter, bits_for, passing
from .graph import AT_ONCE, components

WORDS = 3
RADIUS = 3
HASH_SEED = 42
BUCKET = 1 << 14
_ALL = (1 << 64) - 1


def word_runs(raw: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, A-Z lower-cased, in runs that overlap by words - 1: each shingle is in one run."""
    held: list[bytes] = []
    whole = False
    for part in slices(raw):
        held = held + WORD_BYTES.findall(part.translate(LOWER))
        if len(held) >= words:
            yield held
            whole, held = True, held[len(held) - words + 1 :]
    if held and not whole:
        yield held


def shingle_hashes(raw: bytes, words: int, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of every shingle of a text in UTF-8, repeats included; fewer words are one shingle."""
    digest, out = xxhash.xxh64_intdigest, [np.zeros(0, dtype=np.uint64)]
    for found in word_runs(raw, words):
        line = b" ".join(found)
        if len(found) <= words:
            out.append(np.array([digest(line, seed)], dtype=np.uint64))
            continue
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        out.append(np.array([digest(line[i:j], seed) for i, j in zip(starts, stops)], dtype=np.uint64))
    return np.concatenate(out)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, fp long"), "fingerprints")


def covering(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the bits of free such that any radius bits of it are left out by some mask."""
    bits = [i for i in range(64) if free >> i & 1]
    vectors = (1 << radius + 1) - 1
    # A fixed odd stride spreads each vector over the whole word.
    spread = {bit: k % vectors + 1 for k, bit in enumerate(sorted(bits, key=lambda i: i * 37 % 64))}
    return [sum(1 << i for i, x in spread.items() if (x & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _walk(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Indices (child, parent) of a spanning forest of the links within radius."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found.tolist())
                out.extend((int(x), int(at)) for x in found)
    return out


def _forest(radius: int):
    """Rows sorted by (mask, key) to links: a spanning forest of every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            tag, a, b = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(rows) > 1:
                cut = np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))[0] + 1
                starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(rows)]])
                fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
                two = starts[stops - starts == 2]
                two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
                child, parent = [two], [two + 1]
                many = stops - starts > 2
                for i, j in zip(starts[many].tolist(), stops[many].tolist()):
                    if found := _walk(fps[i:j], radius):
                        x = np.array(found)
                        child.append(i + x[:, 0])
                        parent.append(i + x[:, 1])
                child, parent = np.concatenate(child), np.concatenate(parent)
                tag, a, b = rows[child, 0], rows[child, 3], rows[parent, 3]
            return pa.RecordBatch.from_arrays([pa.array(tag.astype(np.int32)), pa.array(a), pa.array(b)], names=["tag", "a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = np.column_stack([np.asarray(batch.column(c)) for c in ("tag", "mask", "key", "fp")]).astype(np.int64)
            rows = np.concatenate([held, rows])
            # The last bucket may go on in the next batch; it has BUCKET rows at most.
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = rows[last:]
            if last:
                yield links(rows[:last])
        yield links(held)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links tag, a, b that span the components of fps (distinct tag, fp) at radius: every linked pair of one tag is connected."""
    spark = fps.sparkSession
    masks = {0: covering(_ALL, radius)}
    rows, found = fps.select("tag", "fp", F.lit(0).cast("long").alias("mask")), []
    while True:
        table = spark.createDataFrame([(signed(m), [signed(x) for x in xs]) for m, xs in masks.items()], "mask long, next array<long>")
        rows = rows.join(F.broadcast(table), "mask").select("tag", "fp", F.explode("next").alias("mask")).withColumn("key", F.expr("fp & mask"))
        hot = materialize(rows.groupBy("tag", "mask", "key").count().where(F.col("count") > bucket).select("tag", "mask", "key"), "hot-buckets")
        any_hot = bool(hot.limit(1).count())
        calm = rows.join(hot, ["tag", "mask", "key"], "left_anti") if any_hot else rows
        calm = calm.select("tag", "mask", "key", "fp").repartition("tag", "mask", "key").sortWithinPartitions("tag", "mask", "key", "fp")
        found.append(calm.mapInArrow(_forest(radius), "tag int, a long, b long"))
        if not any_hot:
            break
        rows = rows.join(hot, ["tag", "mask", "key"], "left_semi").select("tag", "fp", "mask")
        fixed = {m | x for m, xs in masks.items() for x in xs}
        masks = {m: [m | x for x in covering(_ALL & ~m, radius)] for m in fixed}
        rows = rows.distinct()
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct()


def near_groups(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for every row of fps (doc_id, fp)."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select(F.lit(0).alias("tag"), "fp"), radius, bucket))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    return fps.join(nodes.join(least, F.col("root") == F.col("r")).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Shingles that occur _FREQUENT times in the sampled share of the documents (one of _RATE, all of a small table) come last in every prefix; _LAST at most.
_SAMPLE, _RATE, _FREQUENT, _LAST = 20_000, 2, 3, 1 << 21
#: Members of a shingle up to which all their pairs are compared; larger groups are first thinned by LEADERS rounds.
SMALL, LEADERS = 32, 4
#: 64-bit words of the bitmap of a set, by which pairs that can't be alike are told before their sets are fetched.
_BITMAP = 32


#: Shingles whose sets a task holds before it hands them on: 2 MB of hashes, and one set more at most.
_AT_HAND = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: pa.Scalar, words: int) -> np.ndarray:
    """64-bit hashes of the set of shingles, sorted: those of the words, mixed in their order."""
    out = [np.zeros(0, dtype=np.uint64)]
    for found in word_runs(text.as_buffer().to_pybytes() if text.is_valid else b"", words):
        k = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(HASH_SEED)), dtype=np.uint64, count=len(found))
        m = min(words, len(k))
        h = np.full(len(k) - m + 1, m, dtype=np.uint64)
        for j in range(m):
            h = (h ^ k[j : len(k) - m + 1 + j]) * _ODD
            h ^= h >> np.uint64(32)
        out.append(h)
    return np.unique(np.concatenate(out))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows in runs with the sets of their texts; a run ends as soon as its sets hold _AT_HAND shingles."""
    for b in batches:
        start, held, size = 0, [], 0
        for i, t in enumerate(b.column("text"), 1):
            held.append(shingle_set(t, words))
            size += len(held[-1])
            if size >= _AT_HAND or i == len(b):
                yield b.slice(start, i - start), held
                start, held, size = i, [], 0
        give_back()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as lists."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def _counted(words: int):
    """Texts to hashes of shingles and the number of sets that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, words):
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def frequent_shingles(docs: DataFrame, words: int, last: int = _LAST) -> np.ndarray:
    """Hashes that are frequent in a share of the documents, the rarest first. They only decide the order in which prefixes are taken, not the result."""
    rate = max(1, min(_RATE, docs.count() // _SAMPLE))
    counts = docs.where(F.pmod("hash", F.lit(rate)) == 0).select("text").mapInArrow(_counted(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where(F.col("n") >= _FREQUENT), "frequent-shingles")
    # The least count such that no more than last hashes reach it; counts beyond 1000 are one class here.
    above, least = 0, _FREQUENT
    for r in counts.groupBy(F.least("n", F.lit(1000)).alias("c")).count().orderBy(F.desc("c")).collect():
        if above + r["count"] > last:
            least = r.c + 1
            break
        above += r["count"]
    found = counts.where(F.col("n") >= least).toArrow() if above else counts.limit(0).toArrow()
    discard(counts)
    h, n = found.column("h").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    return h[np.lexsort((h, n))]


def _marked(frequent, words: int, least: float):
    """Texts to what prefixes() returns of them. frequent: a broadcast of frequent_shingles()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(frequent.value)
        known = frequent.value[rank]
        for b, sets in _sets(batches, words):
            digest, size, prefix, bitmap, fp = [], [], [], [], []
            for h in sets:
                digest.append(xxhash.xxh128_digest(h.astype("<u8").tobytes()))
                size.append(len(h))
                fp.append(signed(fingerprint(h)))
                bits = np.zeros(64 * _BITMAP, dtype=np.uint8)
                bits[(h >> np.uint64(40)).astype(np.int64) % len(bits)] = 1
                bitmap.append(np.packbits(bits, bitorder="little").view("<i8"))
                m = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1 if len(h) else 0
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                late = np.where(known[at] == h, rank[at] + 1, 0) if len(known) else np.zeros(len(h), np.int64)
                prefix.append(h[np.lexsort((h, late))[:m]])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "hash", "doc_id")), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), _lists(prefix), _lists(bitmap), pa.array(fp, pa.int64())], names=["uid", "hash", "doc_id", "digest", "n", "prefix", "bitmap", "fp"])

    return run


def prefixes(docs: DataFrame, words: int, least: float) -> DataFrame:
    """uid, hash, doc_id, digest of the set of shingles, its size n, its prefix, its bitmap, and its fingerprint, as a written table.

    Two sets of similarity least or more share a shingle of their first n - ceil(least * n) + 1 in one fixed order of all shingles:
    those not known as frequent by hash, then the frequent ones."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.mapInArrow(_marked(frequent, words, least), f"uid binary, hash long, doc_id {kind}, digest binary, n int, prefix array<long>, bitmap array<long>, fp long"), "prefixes")


def _identified(docs: DataFrame) -> DataFrame:
    """docs with hash (64 bits, for filters) and uid (128 bits, what a row is known by) of identifier and text."""
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit("\n"), F.coalesce(F.concat(F.lit("="), F.col("text").cast("string")), F.lit("-")))
    return docs.withColumn("hash", F.xxhash64(key)).withColumn("uid", F.unhex(F.md5(key)))


def _whole(words: int):
    """uid and text to uid and the whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([b.column("uid"), _lists(sets)], names=["uid", "shingles"])

    return run


class _Verifier:
    """Candidate pairs of classes (a, b) to links: those whose whole sets are alike."""

    def __init__(self, texts: DataFrame, classes: DataFrame, words: int, least: float):
        self.texts, self.classes, self.words, self.least = texts, classes, words, least

    def links(self, pairs: DataFrame) -> DataFrame:
        least = self.least
        pairs = materialize(self._hopeful(pairs), "candidates")
        wanted = self.classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi").select("cid", "uid", "hash")
        wanted = materialize(wanted, "candidate-classes")
        found = wanted.count()
        if not found:  # no text is read for no pair
            discard(wanted)
            return pairs
        bits = bits_for(found)
        # Texts of other documents are kept out by the filter; rows that repeat a candidate meet as one.
        sets = passing(self.texts.select("uid", "hash", "text"), bit_filter(wanted, bits), bits).select("uid", "text").mapInArrow(_whole(self.words), "uid binary, shingles array<long>")
        sets = sets.join(wanted.select("uid", "cid"), "uid").groupBy("cid").agg(F.first("shingles").alias("shingles"))
        sets = materialize(sets, "candidate-sets")
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        out = materialize(both.where(common * (1 + least) >= least * (F.size("sa") + F.size("sb")) - 1e-9).select("a", "b"), "copy-links")
        discard(pairs, wanted, sets)
        return out

    def _hopeful(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bitmaps allow the similarity: every bit that differs stands for a shingle of one set alone."""
        marks = self.classes.select("cid", "n", "bitmap")
        both = pairs.join(marks.toDF("a", "na", "ba"), "a").join(marks.toDF("b", "nb", "bb"), "b")
        apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        most = (F.col("na") + F.col("nb")) * (1 - 2 * self.least / (1 + self.least))
        return both.where(apart <= most + 1e-6).select("a", "b")


def _pairs(one: DataFrame, two: DataFrame, least: float, more: str = "true") -> DataFrame:
    """Pairs of members of one shingle whose sizes, and what is left of both sets from that shingle on, allow the similarity."""
    one, two = (df.select("h", *(F.col(c).alias(c + x) for c in df.columns if c != "h")) for df, x in ((one, "1"), (two, "2")))
    left = lambda x: F.col(f"n{x}") - F.col(f"at{x}")
    fits = (F.least("n1", "n2") >= least * F.greatest("n1", "n2") - 1e-6) & (F.least(left("1"), left("2")) >= least / (1 + least) * (F.col("n1") + F.col("n2")) - 1e-6)
    found = one.join(two, "h").where(fits).where(more)
    return found.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct()


def fingerprint_links(classes: DataFrame, verifier: _Verifier, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between classes (cid, fp) among those whose fingerprints are equal or linked by near_links().

    Candidates span what lies within radius, so a link may be missing where one of them is not verified; copy_links() finds it."""
    nodes = materialize(classes.groupBy("fp").agg(F.min("cid").alias("cid")), "fingerprints")
    same = classes.select("fp", F.col("cid").alias("b")).join(nodes.select("fp", F.col("cid").alias("a")), "fp").where("a < b").select("a", "b")
    near = near_links(nodes.select(F.lit(0).alias("tag"), "fp"), radius, bucket).select("a", "b")
    near = near.join(nodes.toDF("a", "one"), "a").join(nodes.toDF("b", "two"), "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    links = verifier.links(same.union(near).distinct())
    discard(nodes)
    return links


def copy_links(classes: DataFrame, verifier: _Verifier, least: float, small: int = SMALL, leaders: int = LEADERS) -> DataFrame:
    """Links a, b between classes (cid, n, prefix, fp) that connect what the similarity connects.

    Fingerprints link what they can; from then on only members of different components are compared. Members of a shingle are compared pair by pair while they are few. In a larger group, round after round one leader
    is compared with the members that no earlier leader has drawn into its component: a group of copies is thinned by a few pairs
    each, without all pairs of it. In the end only members of different components are compared."""
    near = fingerprint_links(classes, verifier)
    each = classes.join(components(near, AT_ONCE), F.col("cid") == F.col("node"), "left").select("cid", "n", F.coalesce("root", "cid").alias("near"), F.posexplode("prefix").alias("at", "h"))
    shared = materialize(each.groupBy("h").count().where("count > 1"), "shared-shingles")
    members = materialize(each.join(shared, "h").select("h", "cid", "n", "at", "near", "count"), "shingle-members")
    few = members.where(F.col("count") <= small).drop("count")
    links = near.union(verifier.links(_pairs(few, few, least, "near1 < near2")))
    if not members.where(F.col("count") > small).limit(1).count():
        discard(shared, members)
    else:
        many = members.where(F.col("count") > small).drop("count", "near")
        drawn = None  # h, root: components that a leader of the shingle has drawn in
        for _ in range(leaders):
            roots = components(links, AT_ONCE)
            rooted = materialize(many.join(roots, F.col("cid") == F.col("node"), "left").select("h", "cid", "n", "at", F.coalesce("root", "cid").alias("root")), "rooted-members")
            still = rooted if drawn is None else rooted.join(drawn.select("h", F.col("lead")).join(rooted.select("h", F.col("cid").alias("lead"), F.col("root").alias("r")), ["h", "lead"]).select("h", F.col("r").alias("root")), ["h", "root"], "left_anti")
            still = materialize(still.select("h", "cid", "n", "at"), "open-members")
            first = still.groupBy("h").agg(F.min(F.struct("cid", "n", "at")).alias("l"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "l.*")
            first = materialize(first, "leaders")
            if not first.limit(1).count():
                break
            links = links.union(verifier.links(_pairs(first, still, least, "cid1 <> cid2")))
            lead = first.select("h", F.col("cid").alias("lead"))
            drawn = lead if drawn is None else drawn.union(lead)
        roots = components(links, AT_ONCE)
        rooted = materialize(many.join(roots, F.col("cid") == F.col("node"), "left").select("h", "cid", "n", "at", F.coalesce("root", "cid").alias("root")), "rooted-members")
        links = links.union(verifier.links(_pairs(rooted, rooted, least, "root1 < root2")))
    return links


def keep_originals(docs: DataFrame, words: int = COPY_WORDS, least: float = COPY_SIMILARITY, small: int = SMALL, leaders: int = LEADERS) -> DataFrame:
    """docs with its own columns, one row of each group of near copies (the smallest doc_id, a null last).

    Near copies agree in their sets of shingles of words with similarity of at least least. Candidates are sets with near
    fingerprints, then all pairs of the rest that share a shingle of their prefixes, so none is missed; each is verified on its whole sets before it becomes a link. Wholly
    equal rows are copies too. Rows that are in no group are not shuffled."""
    names = docs.columns
    docs = carry(docs, "hash", "uid")
    texts = _identified(pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string")))
    marks = prefixes(texts, words, least)
    # Equal sets are one class; only its representative is compared. Written with its number, which is stable from then on.
    classes = marks.groupBy("digest").agg(F.min(F.struct("uid", "hash", "n", "prefix", "bitmap", "fp")).alias("r")).select(F.monotonically_increasing_id().alias("cid"), "digest", "r.*")
    classes = materialize(classes, "set-classes")
    rows_of = materialize(marks.select("uid", "hash", "doc_id", "digest").join(classes.select("cid", "digest"), "digest").drop("digest"), "class-rows")
    discard(marks)
    roots = components(copy_links(classes, _Verifier(texts, classes, words, least), least, small, leaders), AT_ONCE)
    grouped = rows_of.join(roots, F.col("cid") == F.col("node"), "left")
    grouped = materialize(grouped.select("uid", "hash", "doc_id", F.coalesce("root", "cid").alias("group")), "copy-groups")
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    touched = materialize(grouped.join(first, "group").select("uid", "hash", (F.col("uid") == F.col("best.uid")).alias("stays")).distinct(), "near-copies")
    discard(classes, rows_of, grouped)
    bits = bits_for(touched.count())
    bitmaps = bit_filter(touched, bits)
    rows = _identified(docs)
    apart, near = passing(rows, bitmaps, bits, negate=True), passing(rows, bitmaps, bits)
    near = near.join(touched.where("not stays").select("uid"), "uid", "left_anti").select(*rows.columns).dropDuplicates(["uid"])
    return apart.unionByName(near).select(*docs.columns).toDF(*names)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(fingerprints(pick(read(spark, sf_dir, "documents"), "doc_id", "text")))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
