"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one of our own if everything runs in one process, as in tests; on a cluster that is an error, as
    executors would write where the driver cannot read.
    """
    put = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not put:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        put = f"file://{tempfile.gettempdir()}/checkpoints"
    return put.rstrip("/")


# while a table is written: its shuffle files go afterwards, and batches for Python are small, as each task holds some
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


SLICE = 256


def each(*columns: pa.Array) -> Iterator[tuple]:
    """The values of columns side by side, made from a slice of the batch at a time; what Arrow holds in reserve for the
    next batch is given back, as a worker lives through many stages."""
    for k in range(0, len(columns[0]), SLICE):
        yield from zip(*(c.slice(k, SLICE).to_pylist() for c in columns), strict=True)
    pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def for_task(*caches: dict) -> Iterator[None]:
    """Word caches go when a task ends, and the free memory with them: a worker lives on for other stages, idle or not."""
    try:
        yield
    finally:
        for c in caches:
            c.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Intermediate tables in the shared folder. Written tables survive lost executors and cut the lineage.

    Shuffle files of a write go when it is done. Operators drop the tables that nothing reads any more; those that a
    returned DataFrame still reads are listed in `Scratch.live`, for the caller to release once it has used the result.
    """

    live: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        schema, conf = df.schema, self.spark.conf
        before = {name: conf.get(name, None) for name in _WRITING}
        for name, value in _WRITING.items():
            conf.set(name, value)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)
        Scratch.live.append(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes tables that nothing still to be evaluated reads."""
        release(self.spark, [f._scratch_path for f in frames if f is not None])


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables."""
    jvm, hconf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hconf).delete(p, True)
        if path in Scratch.live:
            Scratch.live.remove(path)


def row_key(*cols: str | Column) -> Column:
    """128 bits that tell rows apart by these columns; equal rows share them."""
    c = [F.col(x) if isinstance(x, str) else x for x in cols]
    flags = F.concat_ws("", *(x.isNull().cast("string") for x in c))
    return F.struct(F.xxhash64(*c, flags).alias("a"), F.xxhash64(flags, F.lit(97), *c).alias("b"))


ROWS_IN_BUCKET = 200_000


def gapless(df: DataFrame, groups: list[str], order: list[str], name: str, salt: Column, rows: int | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps.

    A group is first split by the salt, into so many buckets that one of them holds about ROWS_IN_BUCKET of `rows` (the
    row count, found out if it is not given), so that no task holds a whole group; the bucket offsets are a table of at
    most len(groups) * buckets rows. Rows that agree in the salt share a bucket: a salt should tell all rows apart that
    can be told apart, and may add a random part for those that cannot.
    """
    b = f"__{name}_b"
    buckets = max(16, -(-(df.count() if rows is None else rows) // ROWS_IN_BUCKET))
    df = df.withColumn(b, F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*groups, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = F.row_number().over(Window.partitionBy(*groups, b).orderBy(*order))
    out = df.withColumn("__r", inner)
    cond = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.col(f"l.{b}") == F.col(f"r.{b}")]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    keep = [F.col(f"l.{c}") for c in df.columns if c != b]
    return out.alias("l").join(offsets.alias("r"), on).select(*keep, (F.col("r.__o") + F.col("l.__r") - 1).cast("long").alias(name))
