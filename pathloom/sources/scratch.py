"""Intermediate results that are read several times, written once where all executors can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pathloom-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and read back: its lineage ends there, and lost executors lose nothing. Removed when the driver ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _remove() -> None:
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)
    for spark, path in _written:
        try:
            context = spark.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
