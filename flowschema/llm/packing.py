"""Best-fit packing planned on a length histogram.

Texts are tokenized once and cut into pieces of at most CAPACITY tokens (only documents longer than that are cut). The
histogram of piece lengths has at most CAPACITY rows, whatever the input; on it the driver runs best-fit decreasing over
counts: groups of equal, partly filled sequences take the next shorter length where it leaves the least room. The result is
a table of planned slots: a range of ranks within a length goes to a range of sequences at one offset. Pieces take their
slots by joining on their rank within their length.

Ranks are numbered in salted parts of a length, each of about RANK_ROWS rows, so that a length that a third of all
pieces share is not one task. The plan has a few rows per length (a group of sequences is split at most once per
length), which bounds what is broadcast.

Defined cases: a null text is empty and has the end token alone; repeated rows are packed as often as they occur; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carry, materialize, pick, read

CAPACITY = 4096
END = 1
RANK_ROWS = 50_000
VOCABULARY = "word_bpe_49k.json"
CACHE = 600_000  # pieces of text whose ids a worker remembers
#: Texts of these characters alone are split here; all others go through the tokenizer whole.
_PLAIN = re.compile("[\t-\r -~¡-įı-ȶ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|[0-9]|(?:[^\\w\\s]|_)+")
_NUMBERS = re.compile("[²³¹¼-¾]")
#: Byte-level spelling: bytes that are no printable character become the characters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SPELLED = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer itself encodes every distinct part of a text once; the ids of a text are those of its parts in a row,
    since its pre-tokenizer never lets ids cross parts. Texts outside a plain range of characters, or with special tokens
    in them, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or "<|" in text or _NUMBERS.search(text):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        parts = _PARTS.findall(text.lower())
        known = self.known
        new = list({p for p in parts if p not in known})
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(parts))
            model = self.whole.model
            for p in new:
                # The model takes parts with their bytes spelled as characters.
                spelled = p if p.isascii() else p.encode().decode("latin-1").translate(_SPELLED)
                known[p] = self.pack([t.id for t in model.tokenize(spelled)])
        return b"".join([known[p] for p in parts])


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process; it is kept from task to task."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, digests: bool = False) -> DataFrame:
    """doc_id, piece, start, length, and ids (binary, unsigned 32-bit little-endian) or with digests their ids_crc32."""
    import zlib

    path = path or vocabulary_path()
    last = WordTokenizer.pack([end])
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(path)
        for b in batches:
            row, number, start, length, ids = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                all_ids = words.encode(text.as_py() or "") + last
                for k in range(0, len(all_ids), step):
                    part = all_ids[k : k + step]
                    row.append(i)
                    number.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    ids.append(zlib.crc32(part) if digests else part)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.int64() if digests else pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32" if digests else "ids"],
            )

    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, " + ("ids_crc32 long" if digests else "ids binary"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number of ranks, first sequence, offset) of each range.

    A group is (room, first sequence, number of sequences); a heap per room, and the rooms in a sorted list."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    slots, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups.get(room):
                insort(rooms, room)
                groups[room] = []
            heapq.heappush(groups[room], (first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = heapq.heappop(groups[room])
                if not groups[room]:
                    del rooms[at]
            else:
                room, first = capacity, sequences
                # As many new sequences as hold what is left, several of this length in each.
                n = -(-left // (capacity // length))
                sequences += n
            used = min(n, left)
            slots.append((length, rank, used, first, capacity - room))
            put(room - length, first, used)
            put(room, first + used, n - used)
            rank, left = rank + used, left - used
    return slots


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (column length, 1 to capacity) with their columns, and sequence_id and offset."""
    rows = carry(rows, "sequence_id", "offset")
    rows = materialize(rows, "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    spark = rows.sparkSession
    slots = spark.createDataFrame(plan(histogram, capacity), "l long, first long, n long, sequence long, place long")
    # Salts only where a length is frequent; the order within a salt is by the row's own values.
    salts = spark.createDataFrame([(k, 1 + n // RANK_ROWS) for k, n in histogram.items()], "l long, salts long")
    order = [c for c in rows.columns if c != "length"]
    salted = rows.join(F.broadcast(salts), F.col("length") == F.col("l")).drop("l")
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("salts"))).drop("salts")
    parts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("length").alias("l"), F.col("__salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))
    ranked = ranked.join(parts, (F.col("length") == F.col("l")) & (F.col("__salt") == F.col("s"))).withColumn("__rank", F.col("__rank") - 1 + F.col("base")).drop("l", "s", "base", "__salt")
    # The ranges of one length as one sorted array: a rank finds its slot by the last range that begins at or below it.
    taken = slots.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "place"))).alias("slots"))
    out = ranked.join(F.broadcast(taken), F.col("length") == F.col("l"))
    out = out.withColumn("__slot", F.element_at(F.filter("slots", lambda x: x["first"] <= F.col("__rank")), -1))
    return out.select(*rows.columns, (F.col("__slot.sequence") + F.col("__rank") - F.col("__slot.first")).alias("sequence_id"), F.col("__slot.place").alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(read(spark, sf_dir, "documents"), digests=True))
