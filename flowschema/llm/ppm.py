"""Language-model scoring by prediction by partial matching (PPM).

Training. Texts are lower-cased (A-Z) and their words joined by single spaces, with an end symbol. Every symbol is
counted with the ORDER bytes before it, and all counted contexts of orders 0 to ORDER make the model: none is dropped.

Probabilities. A context with N symbols of d kinds gives a symbol (2n - 1) / 2N and escapes with d / 2N (method D) to
the context without its first byte, where the symbols of the longer context are excluded; below the empty
context all remaining bytes are alike. So the probability of a symbol depends only on it and the ORDER bytes before it
(its gram), and on the counts of contexts that end in the same bytes.

The work. Each block of documents asks once for each of its different grams and words: requests are packed, one row for each
bucket that the block needs. A gram's bucket is that of the last _KNOWN + 1 bytes of its context, so all its longer contexts are there; the
contexts of up to _KNOWN bytes are summed in one table, which the alphabet bounds, and broadcast. One shuffle brings the
requests of a bucket together; the answers (probabilities, or the corpus counts of words for the word-unigram base) return to
their blocks, where they meet the documents. The number of buckets follows the bytes of the input; beyond BUCKETS_MOST of them the requests of a
bucket are first merged in salted groups of blocks, and the answers take the same way back, so neither a task nor a broadcast grows with the corpus
but by the different grams of one bucket. Documents travel compressed, and tables are deleted as soon as they are used up.

Defined cases: a null text counts as empty (the end token alone); a null identifier counts as the empty text in the
split; repeated rows are scored and counted as often as they occur; without training rows every byte has
probability 1/256; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, empty_like, give_back, id_crc, materialize, pick, read, scratch_path, slices

ORDER = 6
END = b"\n"
_PAD = b"\0" * (ORDER - 1) + b" "
_CHUNK = 1 << 20
_KNOWN = 2
_BLOCK_BYTES = 12 << 20
_BLOCK_ROWS = 60_000
#: Bytes of text for each bucket of grams, the number of buckets, and bytes of text that a task may answer for.
BUCKET_BYTES, BUCKETS_LEAST, BUCKETS_MOST, SALT_BYTES = 4 << 20, 256, 4096, 64 << 20
SEGMENT = 512
_STATES_AT_ONCE = 8192


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; bytes.split() knows exactly the white space 20 and 09 to 0D."""
    return raw.translate(LOWER).split()


def line_of(raw: bytes) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join(x for x in (b" ".join(words_of(part)) for part in slices(raw)) if x)


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def gram_keys(stream: bytes) -> np.ndarray:
    """Keys of all predicted symbols of padded texts in a row: symbol in the low byte, the bytes before it above."""
    b = np.frombuffer(stream, dtype=np.uint8)
    if len(b) <= ORDER:
        return np.zeros(0, dtype=np.uint64)
    n = len(b) - ORDER
    key = np.zeros(n, dtype=np.uint64)
    inside = np.ones(n, dtype=bool)
    for j in range(ORDER):
        part = b[j : j + n]
        key |= part.astype(np.uint64) << np.uint64(8 * (ORDER - j))
        inside &= part != END[0]
    key |= b[ORDER:].astype(np.uint64)
    return key[inside]


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys = np.sort(keys)
        at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.concatenate([at, [len(keys)]]))
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context, symbol) in this task."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, size, distinct = [], 0, 0

    def out() -> pa.RecordBatch:
        keys, n = _counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    def count() -> None:
        nonlocal size, distinct
        parts.append(_counted(gram_keys(b"".join(held))))
        distinct += len(parts[-1][0])
        held.clear()
        size = 0

    for b in batches:
        for t in b.column("text"):
            line = line_of(_bytes(t))
            held.append(_PAD + line + END)
            size += len(line) + ORDER + 1
            if size >= _CHUNK:
                count()
            if distinct > 1_500_000:
                yield out()
                distinct = 0
    if held:
        count()
    if parts:
        yield out()


class Trie:
    """The automaton: next state and log10 probability of every (state, symbol)."""

    def __init__(self, contexts: dict[int, np.ndarray], order: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        """contexts: sorted keys of each order from 0; counts n of symbols in contexts (order, context, symbol)."""
        used = np.unique(symbol)
        self.code = np.full(256, len(used), dtype=np.int32)
        self.code[used] = np.arange(len(used))
        a = self.width = len(used) + 1  # the last column stands for every byte never seen
        base = {k: sum(len(contexts[j]) for j in range(k)) for k in contexts}
        states = sum(len(x) for x in contexts.values())
        state = lambda k, keys: base[k] + np.searchsorted(contexts[k], keys)
        step = np.zeros((states, a), dtype=np.int32)
        logp = np.zeros((states, a), dtype=np.float32)
        unseen = 256 - len(used)
        above: dict[str, np.ndarray] = {}
        for k in sorted(contexts):
            keys = contexts[k]
            rows = np.arange(base[k], base[k] + len(keys))
            suffix = state(k - 1, keys & np.uint64((1 << 8 * (k - 1)) - 1)) if k else np.zeros(1, np.int64)
            mine = np.nonzero(order == k)[0]
            place = np.searchsorted(keys, context[mine])
            by_place = np.argsort(place, kind="stable")
            mine, place = mine[by_place], place[by_place]
            count = np.zeros((len(keys), a), dtype=np.float32)
            lower = np.zeros((len(keys), a), dtype=np.float32)
            total, kinds = np.zeros(len(keys)), np.zeros(len(keys))
            for i in range(0, len(keys), _STATES_AT_ONCE):
                part = slice(i, min(i + _STATES_AT_ONCE, len(keys)))
                one, two = np.searchsorted(place, [part.start, part.stop])
                c = np.zeros((part.stop - part.start, a))
                np.add.at(c, (place[one:two] - i, self.code[symbol[mine[one:two]]]), n[mine[one:two]])
                seen = c > 0
                c = np.where(seen, 2 * c - 1, 0)
                t, d = c.sum(1), seen.sum(1)
                if k == 0:
                    low = np.full((1, a), -np.log10(max(256 - int(d[0]), 1)))
                else:
                    at = suffix[part] - base[k - 1]
                    up = above["count"][at].astype(np.float64)
                    rest = above["total"][at] - (up * seen).sum(1)
                    kind = above["kinds"][at] - d
                    both = np.maximum(rest + kind, 1e-300)
                    escape = np.where(kind > 0, np.log10(np.maximum(kind, 1) / both), 0.0)
                    with np.errstate(divide="ignore"):
                        low = np.where(up > 0, np.log10(up) - np.log10(both)[:, None], escape[:, None] + above["lower"][at])
                with np.errstate(divide="ignore", invalid="ignore"):
                    here = np.log10(c) - np.log10(t + d)[:, None]
                    miss = np.where(d > 0, np.log10(np.maximum(d, 1) / np.maximum(t + d, 1)), 0.0)
                logp[rows[part]] = np.where(seen, here, miss[:, None] + low)
                count[part], lower[part], total[part], kinds[part] = c, low, t, d
            step[rows] = step[suffix] if k else 0
            above = {"count": count, "total": total, "kinds": kinds, "lower": lower}
            # Contexts one longer are reached from their first k bytes.
            if k + 1 in contexts and len(contexts[k + 1]):
                longer = contexts[k + 1]
                first = longer >> np.uint64(8)
                known = np.isin(first, keys)
                to = self.code[(longer[known] & np.uint64(255)).astype(np.int64)]
                step[state(k, first[known]), to] = base[k + 1] + np.nonzero(known)[0]
        self.unseen, self.step, self.logp = unseen, step.ravel(), logp.ravel()
        pad = int.from_bytes(_PAD, "big")
        self.start = 0
        for k in sorted(contexts):
            key = np.uint64(pad & ((1 << 8 * k) - 1))
            at = np.searchsorted(contexts[k], key)
            if at < len(contexts[k]) and contexts[k][at] == key:
                self.start = base[k] + int(at)

    def score(self, lines: list[bytes]) -> np.ndarray:
        """log10 probability of each text (words joined by single spaces), its end included."""
        out = np.zeros(len(lines))
        if not lines:
            return out
        stream = self.code[np.frombuffer(END.join([*lines, b""]), dtype=np.uint8)]
        size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        pieces = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(lines)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[doc] + nth * SEGMENT
        length = np.minimum(size[doc] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        doc, nth, at, length = doc[order], nth[order], at[order], length[order]
        state = np.zeros(len(doc), dtype=np.int64)
        a = self.width
        late = np.nonzero(nth)[0]
        for t in range(-ORDER, 0):
            state[late] = self.step.take(state[late] * a + stream[at[late] + t])
        state[nth == 0] = self.start
        total = np.zeros(len(doc))
        live = len(doc) - np.searchsorted(length[::-1], np.arange(SEGMENT), side="right")
        for t in range(int(length[0])):
            m = int(live[t])
            flat = state[:m] * a + stream[at[:m] + t]
            total[:m] += self.logp.take(flat)
            state[:m] = self.step.take(flat)
        np.add.at(out, doc, total)
        return out


def train(docs: DataFrame) -> Trie:
    """The whole model of a corpus that is small enough for the driver, as an automaton."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_grams, "gram long, n long")
    grams = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = grams.column("gram").to_numpy().astype(np.uint64), grams.column("n").to_numpy()
    order, keys, total = [], [], []
    for k in range(ORDER + 1):
        key, t = _counted(gram & _mask(k + 1), n)
        order.append(np.full(len(key), k))
        keys.append(key)
        total.append(t)
    contexts = {k: x for k, x in enumerate(np.unique(x >> np.uint64(8)) for x in keys) if len(x)} or {0: np.zeros(1, dtype=np.uint64)}
    key = np.concatenate(keys)
    return Trie(contexts, np.concatenate(order), key >> np.uint64(8), (key & np.uint64(255)).astype(np.int64), np.concatenate(total).astype(np.float64))


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram, which only the last _KNOWN + 1 bytes of its context decide."""
    last = (grams >> np.uint64(8)) & _mask(_KNOWN + 1)
    return ((last * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _zip(*arrays: np.ndarray) -> bytes:
    """Integers of any size, byte plane by byte plane, compressed; empty high planes are left out."""
    out = [len(arrays).to_bytes(1, "little")]
    for x in arrays:
        planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)
        width = next((k for k in range(8, 0, -1) if planes[:, k - 1].any()), 0)
        body = planes[:, :width].T.tobytes()
        packed = pa.compress(body, codec="zstd", asbytes=True) if body else b""
        out.append(len(x).to_bytes(5, "little") + width.to_bytes(1, "little") + len(packed).to_bytes(5, "little") + packed)
    return b"".join(out)


def _unzip(raw: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(raw[0]):
        n, width, size = int.from_bytes(raw[at : at + 5], "little"), raw[at + 5], int.from_bytes(raw[at + 6 : at + 11], "little")
        x = np.zeros((n, 8), np.uint8)
        if width:
            x[:, :width] = np.frombuffer(pa.decompress(raw[at + 11 : at + 11 + size], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += 11 + size
    return out


def _zip_words(words: list[bytes], times: np.ndarray) -> bytes:
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return _zip(size, np.frombuffer(b"".join(words), np.uint8), times)


def _unzip_words(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    size, body, times = _unzip(raw)
    ends = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(body.astype(np.uint8))]), times.astype(np.int64)


class Level:
    """The (context, symbol) pairs of one order, sorted: counts n, and of their context 2N (total) and d (kinds).

    low: probability of the symbol below the context, whose own symbols are excluded."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, below: Level | None):
        self.keys, self.n = keys, n
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))[: len(keys)]
        times = np.diff(np.append(first, len(keys)))
        each = lambda x: np.repeat(np.add.reduceat(x, first), times) if len(x) else x
        self.total, self.kinds = each(2.0 * n), each((n > 0).astype(np.float64))
        if below is None:
            self.low = 1 / np.maximum(256 - self.kinds, 1)
            return
        at = np.searchsorted(below.keys, keys & below.mask)
        up = below.n[at]
        rest = np.maximum(below.total[at] - each(np.where(n > 0, 2.0 * up, 0.0)), 1)
        kinds = below.kinds[at] - self.kinds
        self.low = np.where(up > 0, (2 * up - 1) / rest, np.where(kinds > 0, kinds / rest, 1.0) * below.low[at])

    def logp(self) -> np.ndarray:
        total = np.maximum(self.total, 1)
        return np.log10(np.where(self.n > 0, (2 * self.n - 1) / total, np.where(self.kinds > 0, self.kinds / total, 1.0) * self.low))


def _levels(keys: np.ndarray, n: np.ndarray, order: int, below: Level | None) -> Level:
    """The level of order, from the sorted distinct pairs of that order and the level below the least one."""
    least = 0 if below is None else _KNOWN + 1
    pairs = {order: (keys, n)}
    for k in range(order - 1, least - 1, -1):
        pairs[k] = _counted(pairs[k + 1][0] & _mask(k + 1), pairs[k + 1][1])
    for k in range(least, order + 1):
        below = Level(*pairs[k], below)
        below.mask = _mask(k + 1)
    return below


def _keys(stream: bytes) -> Iterator[np.ndarray]:
    """gram_keys() of a stream in chunks, in order."""
    for at in range(0, len(stream) - ORDER, _CHUNK):
        yield gram_keys(stream[at : at + _CHUNK + ORDER])


def _different(stream: bytes) -> np.ndarray:
    """The different keys of a stream, sorted."""
    held = [np.zeros(0, np.uint64)]
    for k in _keys(stream):
        held.append(_counted(k)[0])
        if sum(map(len, held)) > 1 << 21:
            held = [_counted(np.concatenate(held))[0]]
    return _counted(np.concatenate(held))[0]


def _places(every: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys are in every, which holds them all; sorted look-ups are the fast ones."""
    order = np.argsort(keys)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.searchsorted(every, keys[order])
    return out


def _distinct(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for k in _keys(b"".join(_PAD + x + END for x in lines)):
        parts.append(_counted(k))
        if sum(len(x) for x, _ in parts) > 1 << 21:
            parts = [_counted(*map(np.concatenate, zip(*parts)))]
    return _counted(*map(np.concatenate, zip(*parts)))


def _scan(buckets: int):
    """Documents to rows of three kinds: documents of a block (text), its packed requests to a bucket (ask), and its pairs of order _KNOWN (pair).

    Buckets of grams are numbered from 0, those of words from -1 down."""
    word_buckets = max(1, buckets // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema: pa.Schema | None = None

        def rows(kind: str, n: int, /, **columns: pa.Array) -> pa.RecordBatch:
            columns["kind"] = pa.array([kind] * n, pa.string())
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().int >> 65
            for i, j in _runs([len(x[2]) for x in held], 1 << 20):
                part = held[i:j]
                lines = END.join([*(x[2] for x in part), b""])
                packed = len(lines).to_bytes(8, "little") + pa.compress(lines, codec="zstd", asbytes=True)
                yield rows("text", 1, block=pa.array([block]), seq=pa.array([i], pa.int32()), ids=pa.array([[x[0] for x in part]], schema.field("ids").type), held=pa.array([[x[1] for x in part]]), data=pa.array([packed], pa.binary()))
            names, number, n_words = _numbered([x[2] for x in held])
            n_train = np.bincount(number[np.repeat([not x[1] for x in held], n_words)], minlength=len(names))
            place = np.fromiter((zlib.crc32(w) % word_buckets for w in names), dtype=np.int64, count=len(names))
            order = np.argsort(place, kind="stable")
            for b, at in _parts(place[order]):
                mine = order[at]
                yield rows("ask", 1, block=pa.array([block]), bucket=pa.array([-1 - b], pa.int32()), data=pa.array([_zip_words([names[i] for i in mine], n_train[mine])], pa.binary()))
            del names, number, n_train, place, order
            k1, t1 = _distinct([x[2] for x in held if not x[1]])
            k2 = _different(b"".join(_PAD + x[2] + END for x in held if x[1]))
            held.clear()
            keys, times = _counted(np.concatenate([k1, k2]), np.concatenate([t1, np.zeros(len(k2), np.int64)]))
            del k1, t1, k2
            pair, of_pair = _counted(keys & _mask(_KNOWN + 1), times)
            for i in range(0, len(pair), 100_000):
                m = len(pair[i : i + 100_000])
                yield rows("pair", m, block=pa.array([block] * m), bucket=pa.array(pair[i : i + m].astype(np.int32)), n=pa.array(of_pair[i : i + m]))
            place = _bucket(keys, buckets)
            order = np.argsort(place, kind="stable")
            keys, times = keys[order], times[order]
            for b, at in _parts(place[order]):
                yield rows("ask", 1, block=pa.array([block]), bucket=pa.array([b], pa.int32()), data=pa.array([_zip(keys[at], times[at])], pa.binary()))
            del keys, times, place, order
            give_back()

        size = 0
        for b in batches:
            schema = schema or pa.schema(
                [("block", pa.int64()), ("seq", pa.int32()), ("ids", pa.list_(b.schema.field("doc_id").type)), ("held", pa.list_(pa.bool_())), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("kind", pa.string())]
            )
            for i, t, h in zip(b.column("doc_id"), b.column("text"), b.column("held_out")):
                line = line_of(_bytes(t))
                held.append((i.as_py(), h.as_py(), line))
                size += len(line)
                if size >= _BLOCK_BYTES or len(held) >= _BLOCK_ROWS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _numbered(lines: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of lines in the order they come in, the number of each word of all lines in a row, and how many words each line has."""
    times = np.fromiter((x.count(b" ") + 1 if x else 0 for x in lines), dtype=np.int64, count=len(lines))
    row = b" ".join([b"", *filter(None, lines), b""])  # each word with the space before it
    begin = np.flatnonzero(np.frombuffer(row, np.uint8) == 32)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype("<i8", copy=False)), pa.py_buffer(row)])
    different, number = _encoded([words])
    return [w[1:] for w in different.to_pylist()], number, times


def _sums(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of runs of values, times of them in each run."""
    out = np.zeros(len(times), values.dtype)
    some = times > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(times) - times)[some])
    return out


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about most bytes together."""
    i, total = 0, 0
    for j, n in enumerate(sizes, 1):
        total += n + 1
        if total >= most:
            yield i, j
            i, total = j, 0
    if i < len(sizes):
        yield i, len(sizes)


def _parts(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(sorted_values):
        cut = [0, *(np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1).tolist(), len(sorted_values)]
        for i, j in zip(cut, cut[1:]):
            yield int(sorted_values[i]), slice(i, j)


def _payloads(table: pa.Table) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in table.column("data")]


def _encoded(words: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Different words, and the index of each word of all arrays in a row."""
    coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _merged(table: pa.Table) -> pa.Table:
    """All requests of a salted group of blocks to a bucket as one request."""
    raw = _payloads(table)
    if table.column("bucket")[0].as_py() < 0:
        words, times = zip(*map(_unzip_words, raw))
        different, at = _encoded(list(words))
        data = _zip_words(different.to_pylist(), np.bincount(at, weights=np.concatenate(times), minlength=len(different)).astype(np.int64))
    else:
        keys, times = zip(*map(_unzip, raw))
        data = _zip(*_counted(np.concatenate(keys), np.concatenate(times).astype(np.int64)))
    return table.slice(0, 1).select(["salt", "bucket"]).append_column("data", pa.array([data], pa.binary()))


def _answers(known):
    """The requests to a bucket to its answers: data holds, in the order of a request, log10 probabilities or corpus counts.

    n, v (of a bucket of words, in its first row): training words, and different ones."""

    def run(table: pa.Table) -> pa.Table:
        raw, rows = _payloads(table), len(table)
        n, v = [0] * rows, [0] * rows
        if table.column("bucket")[0].as_py() < 0:
            words, times = zip(*map(_unzip_words, raw))
            different, at = _encoded(list(words))
            c = np.bincount(at, weights=np.concatenate(times), minlength=len(different)).astype(np.int64)
            n[0], v[0] = int(c.sum()), int((c > 0).sum())
            ends = np.cumsum([0, *map(len, words)])
            out = [_zip(c[at[i:j]]) for i, j in zip(ends, ends[1:])]
        else:
            keys, times = zip(*map(_unzip, raw))
            grams, count = _counted(np.concatenate(keys), np.concatenate(times).astype(np.int64))
            logp = _levels(grams, count, ORDER, known.value).logp().astype("<f4").view("<u4")
            out = [_zip_values(logp[np.searchsorted(grams, k)]) for k in keys]
        kept = table.select([c for c in table.column_names if c != "data"])
        return kept.append_column("data", pa.array(out, pa.binary())).append_column("n", pa.array(n, pa.int64())).append_column("v", pa.array(v, pa.int64()))

    return run


def _zip_values(x: np.ndarray) -> bytes:
    """Few different values: those, and which of them each is."""
    values, at = np.unique(x, return_inverse=True)
    return _zip(values, at)


def _unzip_values(raw: bytes) -> np.ndarray:
    values, at = _unzip(raw)
    return values.astype("<u4").view("<f4")[at.astype(np.int64)]


def _spread(asked: pa.Table, merged: pa.Table) -> pa.Table:
    """Answers to the one request of a salted group (data, with its request in keys) to those to each of its blocks."""
    raw, whole, answer = _payloads(asked), merged.column("keys")[0].as_buffer().to_pybytes(), merged.column("data")[0].as_buffer().to_pybytes()
    if asked.column("bucket")[0].as_py() < 0:
        words = [_unzip_words(x)[0] for x in raw]
        every = _unzip_words(whole)[0]
        _, at = _encoded([every, *words])  # the first len(every) words are all different
        c = _unzip(answer)[0]
        ends = np.cumsum([len(every), *map(len, words)])
        out = [_zip(c[at[i:j]]) for i, j in zip(ends, ends[1:])]
    else:
        every, value = _unzip(whole)[0], _unzip_values(answer).view("<u4")
        out = [_zip_values(value[np.searchsorted(every, _unzip(x)[0])]) for x in raw]
    return asked.select(["block", "bucket"]).append_column("data", pa.array(out, pa.binary()))


def _returned(buckets: int):
    """The documents of a block and the answers to its requests to sums for each document."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.sort_by("seq")
        lines, doc_ids, held = [], [], []
        for ids, out, raw in zip(texts.column("ids"), texts.column("held"), texts.column("data")):
            raw = raw.as_buffer().to_pybytes()
            lines += pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True).split(END)[:-1]
            doc_ids += ids.values.to_pylist() if isinstance(ids, pa.ListScalar) else ids.as_py()
            held += out.as_py()
        answer = dict(zip(answers.column("bucket").to_pylist(), _payloads(answers)))
        names, number, n_words = _numbered(lines)  # the same numbers as in the scan
        word_buckets = max(1, buckets // 4)
        place = np.fromiter((zlib.crc32(w) % word_buckets for w in names), dtype=np.int64, count=len(names))
        count = np.zeros(len(names))
        order = np.argsort(place, kind="stable")
        for b, at in _parts(place[order]):
            count[order[at]] = _unzip(answer[-1 - b])[0]
        log_sum, n_known = _sums(np.log10(count + 1.0)[number], n_words), _sums((count > 0).astype(np.int64)[number], n_words)
        ends = np.cumsum(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1)
        score, done = np.zeros(len(lines)), 0
        # What is used up goes first, and places in chunks are never held: their keys are made twice.
        stream = b"".join(_PAD + x + END for x in lines)
        del lines, number, names, place, order, count
        every = _different(stream)
        place = _bucket(every, buckets)
        logp = np.zeros(len(every), dtype=np.float32)
        order = np.argsort(place, kind="stable")
        for b, at in _parts(place[order]):
            logp[order[at]] = _unzip_values(answer[b])
        del answer, place, order
        for k in _keys(stream):
            if not len(k):
                continue
            value = logp[_places(every, k)].astype(np.float64)
            first, last = np.searchsorted(ends, [done, done + len(k) - 1], side="right")
            # The documents that the chunk touches, from where each of them begins in it.
            begin = np.maximum(np.concatenate([[done], ends[first:last]]) - done, 0)
            score[first : last + 1] += np.add.reduceat(value, begin)
            done += len(k)
        stream = every = logp = k = value = begin = None
        give_back()
        return pa.table({
            "doc_id": pa.array(doc_ids, texts.schema.field("ids").type.value_type), "held_out": pa.array(held, pa.bool_()), "n_words": pa.array(n_words, pa.int64()), "score": pa.array(score),
            "log_sum": pa.array(log_sum, pa.float64()), "known": pa.array(n_known, pa.int64()),
        })

    return run


def lm_scores(docs: DataFrame, folds: int = 7, fold: int = 2, buckets_most: int = BUCKETS_MOST, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    docs = pick(docs, "doc_id", "text").withColumn("held_out", F.pmod(id_crc(), F.lit(folds)) == fold)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "held_out")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(min(max(BUCKETS_LEAST, total // BUCKET_BYTES), buckets_most))
    salts = int(max(1, -(-total // (buckets * salt_bytes))))
    # One folder for each kind of rows, so that requests can go before the rest.
    schema = f"block long, seq int, ids array<{kind}>, held array<boolean>, bucket int, n long, data binary"
    path = scratch_path(spark, "ppm-scan")
    rows.mapInArrow(_scan(buckets), f"{schema}, kind string").write.partitionBy("kind").parquet(path)
    there = {r.kind for r in spark.read.schema(f"{schema}, kind string").parquet(path).select("kind").distinct().collect()}
    scanned = {k: spark.read.schema(schema).parquet(f"{path}/kind={k}") if k in there else empty_like(spark, schema) for k in ("text", "ask", "pair")}
    texts = scanned["text"].select("block", "seq", "ids", "held", "data")
    # The contexts of up to _KNOWN bytes: 2 ** 24 pairs at most, whatever the input.
    low = scanned["pair"].groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(low.column("bucket").to_numpy())
    known = spark.sparkContext.broadcast(_levels(low.column("bucket").to_numpy()[order].astype(np.uint64), low.column("n").to_numpy()[order], _KNOWN, None))
    asked = scanned["ask"].select("block", "bucket", "data")
    if salts == 1:
        answers = materialize(asked.groupBy("bucket").applyInArrow(_answers(known), "block long, bucket int, data binary, n long, v long"), "ppm-answers")
        sums = answers
    else:
        salted = asked.withColumn("salt", F.pmod("block", F.lit(salts)))
        merged = materialize(salted.groupBy("bucket", "salt").applyInArrow(_merged, "salt long, bucket int, data binary"), "ppm-merged")
        sums = materialize(merged.withColumn("keys", F.col("data")).groupBy("bucket").applyInArrow(_answers(known), "salt long, bucket int, keys binary, data binary, n long, v long"), "ppm-merged-answers")
        both = salted.groupBy("bucket", "salt").cogroup(sums.select(F.col("bucket").alias("b"), F.col("salt").alias("s"), "keys", "data").groupBy("b", "s"))
        answers = materialize(both.applyInArrow(_spread, "block long, bucket int, data binary"), "ppm-answers")
        discard(merged)
    n_words, kinds = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = texts.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]
    discard(scanned["ask"], scanned["pair"])
    if salts > 1:
        discard(sums)
    n, v = n_words + ends, kinds + (ends > 0)
    back = answers.select(F.col("block").alias("b"), "bucket", "data")
    summed = texts.groupBy("block").cogroup(back.groupBy("b")).applyInArrow(_returned(buckets), f"doc_id {kind}, held_out boolean, n_words long, score double, log_sum double, known long")
    tokens = F.col("n_words") + 1
    base = F.col("log_sum") + F.lit(float(np.log10(ends + 1.0))) - tokens * F.lit(float(np.log10(n + v + 1.0)))
    return summed.select("doc_id", "held_out", tokens.cast("long").alias("n_tokens"), (F.col("known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))
