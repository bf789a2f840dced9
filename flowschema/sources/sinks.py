"""Writers: one DataFrame to files, tables or databases, in one file or in named shards."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

_BUCKETS = 4096
_CSV = {"sep": "sep", "na_rep": "nullValue", "header": "header", "quotechar": "quote", "escapechar": "escape", "date_format": "dateFormat", "compression": "compression", "line_terminator": "lineSep", "encoding": "encoding"}
_PARQUET = {"compression": "compression", "row_group_size": "parquet.block.size", "use_dictionary": "parquet.enable.dictionary", "data_page_size": "parquet.page.size", "version": "parquet.writer.version"}


@dataclass
class Writer:
    """kind: csv, json, parquet, orc, pickle, print, jdbc, table. options: those of the format, by the names of pandas or of Spark."""

    kind: str
    options: dict[str, Any] = field(default_factory=dict)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Columns in order, floats and decimals as text, an index column: what a format asks of the values."""
        o = self.options
        if o.get("columns"):
            df = df.select(*o["columns"])
        if self.kind == "parquet" and o.get("no_uint"):
            # Unsigned columns as the next signed type; 64 bits that are decimals here become bigint, and too great a value is an error.
            df = df.select(*(F.col(f"`{f.name}`").cast("bigint").alias(f.name) if f.dataType == S.DecimalType(20, 0) else F.col(f"`{f.name}`") for f in df.schema))
        if self.kind == "csv":
            for f in df.schema:
                if isinstance(f.dataType, (S.FloatType, S.DoubleType)) and o.get("float_format"):
                    df = df.withColumn(f.name, F.when(F.col(f.name).isNotNull(), F.format_string(o["float_format"], F.col(f.name).cast("double"))))
                elif isinstance(f.dataType, (S.ArrayType, S.MapType, S.StructType)):
                    df = df.withColumn(f.name, F.to_json(f.name))
                elif isinstance(f.dataType, S.BinaryType):
                    df = df.withColumn(f.name, F.base64(f.name))
            if o.get("index"):
                # A gapless index needs the rows of all partitions before: counted apart, not in one task.
                df = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
                before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
                starts = df.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
                names = [c for c in df.columns if not c.startswith("__")]
                df = df.join(starts, "__p").select((F.col("__s") + F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)).alias("index"), *names)
        return df

    def known(self) -> dict[str, Any]:
        """The options by the names of Spark's writers."""
        own = ("columns", "index", "float_format", "document", "no_uint", "protocol", "rows", "if_exists")
        names = {"csv": _CSV, "parquet": _PARQUET}.get(self.kind, {})
        out = {names.get(k, k): v for k, v in self.options.items() if k not in own}
        if self.kind == "csv":
            out.setdefault("header", True)
        if self.kind == "parquet" and out.get("parquet.writer.version"):
            out["parquet.writer.version"] = "v1" if str(out["parquet.writer.version"]).startswith("1") else "v2"
        return out

    def write(self, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
        """Write to path. pickle: a file of one pickled list of records per partition; json with document: one array per partition, a file each."""
        df, o = self.prepared(df), self.options
        if self.kind == "print":
            df.show(o.get("rows", 20), False)
        elif self.kind == "pickle" or self.kind == "json" and o.get("document"):
            self._files(df, path, mode)
        elif self.kind == "jdbc":
            df.write.format("jdbc").options(**{k: v for k, v in o.items() if k not in ("columns",)}).option("dbtable", path).mode({"append": "append", "replace": "overwrite", "fail": "errorifexists"}.get(o.get("if_exists", "append"))).save()
        elif self.kind == "table":
            df.write.mode(mode).saveAsTable(path)
        else:
            df.write.format(self.kind).options(**self.known()).mode(mode).save(path)

    def _files(self, df: DataFrame, path: str, mode: str) -> None:
        """Whole files that Spark has no writer for: each task writes its own under the file system of path, tasks that are run again write it again."""
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(folder):
            if mode == "errorifexists":
                raise FileExistsError(path)
            if mode == "overwrite":
                fs.delete(folder, True)
        fs.mkdirs(folder)
        kind, protocol, names = self.kind, self.options.get("protocol", pickle.HIGHEST_PROTOCOL), df.columns
        if kind == "json":
            df = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))

        def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, done = TaskContext.get().partitionId(), 0
            target, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
            name = f"{place}/part-{part:05d}.{'json' if kind == 'json' else 'pickle'}"
            with target.open_output_stream(name) as out:
                if kind == "json":
                    out.write(b"[")
                records: list[dict] = []
                for b in batches:
                    if kind == "json":
                        text = ",\n".join(b.column("line").to_pylist()).encode()
                        out.write((b",\n" if done and text else b"") + text)
                    else:
                        records += b.to_pylist()
                    done += len(b)
                out.write(b"]" if kind == "json" else pickle.dumps([{n: r[n] for n in names} for r in records], protocol))
            yield pa.RecordBatch.from_pydict({"rows": pa.array([done], pa.int64())})

        df.mapInArrow(dump, "rows long").agg(F.sum("rows")).collect()


def _in_shards(df: DataFrame, shards: int) -> DataFrame:
    """df with __shard, its partition: from 0 to shards - 1, counts differ by one at most.

    repartition(n) deals the rows of each task out from a place of its own, so counts differ by up to the number of tasks. Here rows fall into buckets by their values,
    and each bucket is dealt out from where those before it ended. Counts of buckets depend on neither tasks nor pruned columns; they are read in a pass of their own."""
    values = [F.to_json(F.struct(f"`{f.name}`")) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`") for f in df.schema]
    keyed = df.withColumns({"__h": F.xxhash64(*values), "__g": F.xxhash64(F.lit(1), *values)}).withColumn("__b", F.pmod("__h", F.lit(_BUCKETS)))
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    starts = keyed.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "__g")).cast("long")  # ties are equal rows, so tasks that are run again deal alike
    placed = keyed.withColumn("__n", place).join(F.broadcast(starts), "__b")
    return placed.select(*(f"`{c}`" for c in df.columns), F.pmod(F.col("__s") + F.col("__n"), F.lit(shards)).cast("int").alias("__shard")).repartitionById(shards, "__shard")


def write_shards(df: DataFrame, writer: Writer, path: str, shards: int = 1, base: str = "data", part_names: bool = False) -> list[str]:
    """df in equal shards (counts differ by one at most), each a folder base_00000-of-00003 or part-00000. A shard is one file of one task, so size shards to memory.
    df is read twice; if its values change from one reading to the next, all rows are written still, but shards are equal only about."""
    if writer.kind in ("print", "jdbc", "table"):
        raise ValueError(f"{writer.kind} has no files to shard")
    names = [f"part-{i:05d}" if part_names else f"{base}_{i:05d}-of-{shards:05d}" for i in range(shards)]
    if shards == 1:
        writer.write(df.coalesce(1), f"{path}/{names[0]}", "overwrite")
        return names
    rows = _in_shards(writer.prepared(df), shards)
    if writer.kind == "pickle" or writer.kind == "json" and writer.options.get("document"):
        Writer(writer.kind, {k: v for k, v in writer.options.items() if k not in ("columns", "index")})._files(rows.drop("__shard"), path, "overwrite")
        return [f"part-{i:05d}.{writer.kind}" for i in range(shards)]
    name = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("__shard") + 1)
    rows.withColumn("shard", name).drop("__shard").write.format(writer.kind).options(**writer.known()).partitionBy("shard").mode("overwrite").save(path)
    return names
