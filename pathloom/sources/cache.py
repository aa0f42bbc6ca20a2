"""Results kept under a fingerprint of what made them, for any number of builders at a time."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fingerprint(**parts: object) -> str:
    """SHA-256 of the parts as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


class _Files:
    """The file system of a folder, through Spark's own classes."""

    def __init__(self, spark: SparkSession, root: str):
        self.java = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path(root).getFileSystem(configuration)
        self.context = self.java.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), configuration)

    def path(self, name: str):
        return self.java.org.apache.hadoop.fs.Path(name)

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.path(name)):
            return None
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.system.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def claim(self, source: str, target: str) -> bool:
        """Rename a file, if nothing has its new name yet."""
        none = self.gateway.new_array(self.java.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(source), self.path(target), none)
        except Exception as error:  # noqa: BLE001  py4j's own class around Java's
            if "FileAlreadyExists" in str(error) or self.system.exists(self.path(target)):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of ``key`` under ``root``, built and written first if it is not there.

    Each builder writes a folder of its own and, once Spark has committed it, claims the key by renaming a manifest that
    names the folder; the rename of one succeeds. Readers go by the manifest alone, so they never see part of a table,
    and a builder that broke off or came second leaves nothing that is read. The second one's folder is removed.
    """
    files, root = _Files(spark, root), root.rstrip("/")
    manifest = f"{root}/{key}.json"
    if (found := files.read(manifest)) is None:
        attempt = f"{key}.{uuid.uuid4().hex}"
        build().write.parquet(f"{root}/{attempt}")
        files.write(f"{root}/{attempt}.json", json.dumps({"key": key, "folder": attempt}))
        if not files.claim(f"{root}/{attempt}.json", manifest):
            files.remove(f"{root}/{attempt}.json")
            files.remove(f"{root}/{attempt}")
        found = files.read(manifest)
    return spark.read.parquet(f"{root}/{json.loads(found)['folder']}")
