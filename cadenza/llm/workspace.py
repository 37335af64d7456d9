"""Shared working folder, written tables and file access that do not depend on a machine's own disk."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from cadenza.shared import shared_root
from cadenza.shipping import ship

__all__ = ["Workspace", "local_path", "opened", "put", "shared_root", "ship"]

class Workspace:
    """A run's own folder below the shared one. Tables written here cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Remove written tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(conf).delete(p, True)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI, None for any other store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(uri: str, parts) -> int:
    """Write byte strings as one file, under a name of its own until it is whole; a retried task replaces the file with equal bytes."""
    temp, size = f"{uri}.{uuid.uuid4().hex}.tmp", 0
    path = local_path(uri)
    if path is not None:
        temp = local_path(temp)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as out:
            for p in parts:
                size += out.write(p)
        os.replace(temp, path)
        return size
    store, at = _fs(uri)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    held = temp.removeprefix(uri)
    with store.open_output_stream(at + held) as out:
        for p in parts:
            size += len(p)
            out.write(p)
    store.move(at + held, at)
    return size


def opened(uri: str):
    """A seekable file-like object."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    store, at = _fs(uri)
    return store.open_input_file(at)
