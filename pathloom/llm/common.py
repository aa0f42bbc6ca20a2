"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space: space and 0x09-0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []
#: What ``materialize`` wrote within the innermost ``scratch`` block of this thread.
_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)
#: Folders made here because a local session named none.
_own_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session that names none (a local test session) gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs.append(tempfile.mkdtemp(prefix="checkpoint-"))
        context.setCheckpointDir(_own_dirs[-1])
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The copy cuts the lineage and survives lost executors; it is removed when the driver ends, or before by
    ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch() -> Iterator[object]:
    """Within the block, calling what it gives removes all copies that the block made so far but for the last one."""
    made: list[tuple[SparkSession, str]] = []
    token = _made.set(made)

    def keep_last() -> None:
        for spark, path in made[:-1]:
            _remove(spark, path)
            _written.remove((spark, path))
        del made[:-1]

    try:
        yield keep_last
    finally:
        _made.reset(token)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for folder in _own_dirs:
        shutil.rmtree(folder, ignore_errors=True)
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def release_memory() -> None:
    """What Arrow and, where it can be told to, the C library keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run):
    """``run`` over batches; freed memory goes back when a task is done, since its worker waits for the next."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidy


def bounded_batches(df: DataFrame) -> None:
    """Have Spark send rows of whole texts to Python by 2,000, where the session leaves its default of 10,000.

    A batch is held several times over, in the executor and in the worker, so this bounds what long texts take.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "2000")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(rows: DataFrame, **beside: Column) -> DataFrame:
    """All columns of ``rows`` as one struct ``__row``, so that no name of theirs meets another; beside it what is named."""
    return rows.select(F.struct(*map(column, rows.columns)).alias("__row"), *[c.alias(name) for name, c in beside.items()])


def bits_for(keys: int, most: int = 28) -> int:
    """Size of a bit set in which one in sixteen bits or fewer is set, as a power of two; ``most`` bounds what is broadcast."""
    return min(most, max(12, ceil(log2(16 * max(keys, 1)))))


def bit_set(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows (word, mask) of a bit set of 2**bits bits that has a bit for each key."""
    position = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    places = keys.select((position / 64).cast("long").alias("_word"), F.pmod(position, F.lit(64)).cast("int").alias("_bit"))
    return places.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))


def probe_bit_set(rows: DataFrame, key: Column, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``_hit``: whether the key's bit is set. The set is broadcast: at most 2**bits / 64 rows of two longs.

    The columns of ``rows`` must not be named ``_word``, ``_bit``, ``_mask`` or ``_hit``; those of a caller go in ``packed``.
    """
    position = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    probed = rows.withColumn("_word", (position / 64).cast("long")).withColumn("_bit", F.pmod(position, F.lit(64)).cast("int"))
    hit = F.expr("coalesce(getbit(_mask, _bit) = 1, false)")
    return probed.join(F.broadcast(words), "_word", "left").withColumn("_hit", hit).drop("_word", "_bit", "_mask")


def without_rows(rows: DataFrame, dropped: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped``; null keys stay. ``rows`` may have columns of any name.

    A bit set of the dropped keys lets most rows pass without a shuffle; only rows whose bit is set are
    joined with the keys themselves.
    """
    keys = dropped.select(F.col(key).alias("__dropped")).where("__dropped is not null").distinct()
    probed = probe_bit_set(packed(rows, __key=F.col(key)), F.col("__key"), bit_set(keys, F.col("__dropped"), bits), bits)
    asked = probed.where("_hit").join(keys, F.col("__key") == F.col("__dropped"), "left_anti")
    return probed.where("not _hit").select("__row").unionByName(asked.select("__row")).select("__row.*")


def tree_sum(parts: DataFrame, add, schema: str, ranges: int, fan_in: int = 64) -> DataFrame:
    """Tables in parts by ``range``, one set of parts from each task, added up to one part a range.

    Up to ``fan_in`` tasks' parts of a range meet at a time, twice over, so that what the last task of a range
    reads grows with the number of tasks over ``fan_in`` squared. ``add`` sums the parts of equal range.
    """
    for _ in range(2):
        near = parts.withColumn("__near", (F.spark_partition_id() / fan_in).cast("int"))
        parts = near.repartition(shuffle_partitions(parts.sparkSession), "range", "__near").drop("__near").mapInArrow(releasing(add), schema)
    return parts.repartition(ranges, "range").mapInArrow(releasing(add), schema)
