"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every operator here knows, and a word: a run without it.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: A-Z to a-z on bytes, and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_lock = threading.Lock()
_writing: dict[int, list] = {}  # writers at work in a session, and what the setting was before the first of them
_scopes = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where none is set and the master is local, as in tests, it is a temporary folder of this process, which goes with it."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
    with _lock:
        if sc not in _own_dirs:
            folder = tempfile.mkdtemp(prefix="flowschema-")
            weakref.finalize(sc, shutil.rmtree, folder, ignore_errors=True)
            _own_dirs[sc] = "file://" + folder
        return _own_dirs[sc]


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While any table is written: shuffle files go as soon as their job has ended. Writers in other threads may overlap."""
    with _lock:
        state = _writing.setdefault(id(spark), [0, spark.conf.get(_CLEANUP, None)])
        state[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.unset(_CLEANUP) if state[1] is None else spark.conf.set(_CLEANUP, state[1])
                del _writing[id(spark)]


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, known to the scopes that are open in this thread."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", ()):
        scope.append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        with _cleaning(spark):  # nothing reads this job's shuffle files once the table is written
            df.write.options(**options).parquet(path)
    except BaseException:
        delete(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            delete(df.sparkSession, file.rpartition("/")[0])


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Everything that operators write to the shared folder inside the scope is deleted at its end, whatever happens.

    Results are lazy, so write them inside the scope, under a path that is not scratch_path()'s."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    mine: list[str] = []
    _scopes.open.append(mine)
    try:
        yield
    finally:
        _scopes.open.remove(mine)
        for path in mine:
            delete(spark, path)


def slices(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about size bytes, cut at white space, so that a very long text is never one list of words."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield raw[at:end]
        at = end


def give_back() -> None:
    """Freed memory goes back to the system: a worker serves many blocks, and what it keeps of each adds to the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def find(df: DataFrame, name: str) -> int | None:
    """Index of the column called name: the exact spelling first, then any case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    return None


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever other columns are called (repeated or clashing names do no harm)."""
    at = {n: find(df, n) for n in names}
    if missing := [n for n, i in at.items() if i is None]:
        raise ValueError(f"no column {missing} among {df.columns}")
    flat = df.toDF(*(f"__in{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"__in{i}").alias(n) for n, i in at.items()))


def carry(df: DataFrame, *taken: str) -> DataFrame:
    """All columns, those whose names clash with each other or with taken renamed to <name>_in, <name>_in2, ..."""
    used, names = {t.lower() for t in taken}, []
    for c in df.columns:
        new, k = c, 1
        while new.lower() in used:
            new, k = f"{c}_in" + (str(k) if k > 1 else ""), k + 1
        used.add(new.lower())
        names.append(new)
    return df.toDF(*names)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of the identifier as text; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
