"""Helpers that the corpus operators share: the shared work folder, written intermediates, ranks."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space as the contracts define it: blank and code points 9 to 13.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a local master a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="assayer-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: What this process has written to the shared folder.
_WRITTEN: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its scheme; it is deleted when this process ends, or by :func:`release`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def work_folder(spark: SparkSession, name: str) -> str:
    """A :func:`work_path` that is there as an empty folder, for files that tasks write themselves."""
    path = work_path(spark, name)
    fs, place = _hadoop(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discard(*frames: DataFrame) -> None:
    """Delete the tables that :func:`materialize` wrote for these frames, which can't be used afterwards."""
    for df in frames:
        path = df.__dict__.get("_work_path")
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            fs, place = _hadoop(df.sparkSession, path)
            fs.delete(place, True)


@atexit.register
def release() -> None:
    """Delete the intermediate tables of this process. DataFrames that read them can't be used afterwards.

    Where the session has been stopped before, folders on other than local stores go with the JVM, which
    has them marked.
    """
    spark = SparkSession.getActiveSession()
    while _WRITTEN:
        path = _WRITTEN.pop()
        if urlparse(path).scheme == "file":
            shutil.rmtree(urlparse(path).path, ignore_errors=True)
        elif spark is not None:
            fs, place = _hadoop(spark, path)
            fs.delete(place, True)


def materialize(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    What comes out of a shuffle is written by :func:`few_files`, so that small tables don't become
    hundreds of files; ``spread`` keeps the partitions of scans and of heavy stages as they are.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    (df if spread else few_files(df)).write.parquet(path)
    fs, place = _hadoop(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_work_path"] = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage, Python's first: its heap shrinks to what it holds, and Spark's cleaner drops shuffles and broadcasts that no plan uses any more.

    For loops of many small jobs, which would let the heap grow to its limit without ever needing it.
    """
    gc.collect()
    spark._jvm.System.gc()


def materialize_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """:func:`materialize` what ``make`` returns, and delete every intermediate table that it wrote on the way."""
    before = set(_WRITTEN)
    out = materialize(make(), name, spread=True)
    for path in [p for p in _WRITTEN if p not in before and p != out.__dict__["_work_path"]]:
        _WRITTEN.remove(path)
        fs, place = _hadoop(out.sparkSession, path)
        fs.delete(place, True)
    return out


def split_bytes(spark: SparkSession) -> int:
    """The size of a scan's tasks, ``spark.sql.files.maxPartitionBytes``, in bytes."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, after pruning of partitions; tables made on the driver count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def few_files(df: DataFrame) -> DataFrame:
    """A task for each scan split's worth of the files read, two a core at least; for what comes out of a shuffle.

    Each task takes several partitions one after the other. The count follows the input's bytes, so no
    task grows with the input.
    """
    n = -(-input_bytes(df) // split_bytes(df.sparkSession))
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, n))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a DataFrame without Python or RDD code: rows travel as one JSON literal."""
    import json

    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def map_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose ``fn`` takes an iterator of record batches and yields dicts of column lists or Arrow arrays."""
    struct = df.sparkSession.range(0).select().schema if schema is None else (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in target],
                schema=target,
            )

    return df.mapInArrow(run, struct)


def slices(batch: pa.RecordBatch, column: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece take about ``limit`` bytes at most (one text may take more)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def hidden(df: DataFrame, *used: str) -> list[Column]:
    """The columns of ``df``, all but those ``used`` under a name of their place, so that none meets a name of the operator's own."""
    return [F.col(quoted(c)).alias(c if c in used else f"_{i}_") for i, c in enumerate(df.columns)]


def shown(df: DataFrame, *used: str) -> list[Column]:
    """The columns of ``df`` under their names, of a frame that has those of :func:`hidden`."""
    return [F.col(quoted(c)) if c in used else F.col(f"_{i}_").alias(c) for i, c in enumerate(df.columns)]


def quoted(name: str) -> str:
    """A column's name as an expression, whatever dots and quotes it holds."""
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text that is ASCII throughout takes the fast path, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hash128(prefix: str, value: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of a value, for equality keys that don't collide at corpus size."""
    return F.xxhash64(value).alias(f"{prefix}1"), F.xxhash64(F.lit(0x9E3779B9), value).alias(f"{prefix}2")


def salted(df: DataFrame, salts: int = 4) -> DataFrame:
    """Replicate a table that is unique by its join keys over ``salts`` salts (column ``__salt``).

    Joining on the keys and the salt spreads a hot key, and makes the join's own exchange stand on
    both sides, so that adaptive execution can split what is still skewed.
    """
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def with_salt(df: DataFrame, by: Column, salts: int = 4) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def bucket_rank(df: DataFrame, keys: list[str], order: list[str], total: int, out: str = "rank") -> DataFrame:
    """A gapless zero-based rank within each key, without gathering a key in one task.

    ``df`` is read several times and must give the same rows each time. A key of more than ``per`` rows
    (``total / 2000``, 64 to 50,000) is cut into buckets of about so many by a hash of the order columns;
    rows are numbered within key and bucket and shifted by the rows of the key's earlier buckets.
    Only rows equal in all order columns share a bucket by force.
    """
    per = max(64, min(50_000, total // 2000))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > per)
    sizes = materialize(sizes.withColumn("__nb", F.ceil(F.col("__n") / per).cast("int")).drop("__n"), "hot-keys")
    cut = _left_on(with_salt(df, F.struct(*order)), salted(sizes), [*keys, "__salt"]).drop("__salt")
    cut = cut.withColumn("__b", F.coalesce(F.pmod(F.xxhash64(*order), F.col("__nb")), F.lit(0)).cast("int"))
    counts = cut.filter("__nb is not null").groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c"), "offsets")
    within = cut.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__b").orderBy(*order)))
    joined = _left_on(within, offsets, [*keys, "__b"])
    return joined.withColumn(out, F.coalesce("__off", F.lit(0)) + F.col("__r") - 1).drop("__nb", "__b", "__r", "__off")


def _left_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys, nulls equal, with the right side's keys dropped."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(right, on, "left").drop(*[f"__k_{k}" for k in keys])


def ordered_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """A gapless zero-based rank of all rows: range-partitioned, numbered by partition, shifted by exact counts."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    rows = ranged.withColumn("__r", F.row_number().over(W.partitionBy("__pid").orderBy(*order)))
    return rows.join(offsets, "__pid").withColumn(out, F.col("__off") + F.col("__r") - 1).drop("__pid", "__off", "__r")


def local_path(uri: str):
    """A pyarrow filesystem and path for a URI or plain path, usable on executors."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)
