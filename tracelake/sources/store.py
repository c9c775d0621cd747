"""Files and intermediate tables on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Small files and folders by Hadoop's file systems, as Spark sees them."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_file(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    def children(self, path: str) -> list[tuple[str, str, bool, int]]:
        """(path, name, whether it is a file, bytes) of what a folder holds, by name; nothing for a missing folder."""
        fs, at = self._at(path)
        found = fs.listStatus(at) if fs.exists(at) else []
        return sorted((str(s.getPath()), s.getPath().getName(), s.isFile(), s.getLen()) for s in found)

    def size(self, path: str) -> int:
        fs, at = self._at(path)
        return fs.getFileStatus(at).getLen()

    def make_folder(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        source = fs.open(at)
        try:
            return bytes(source.readAllBytes()).decode("utf-8-sig")
        finally:
            source.close()

    def write(self, path: str, text: str) -> None:
        """Writes the file beside its place and moves it there, so that no reader sees half of it."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        fs, at = self._at(part)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        _, to = self._at(path)
        if fs.exists(to):
            fs.delete(to, False)
        fs.rename(at, to)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one under a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_root()}"


@functools.cache
def _local_root() -> str:
    """One folder for this process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="tracelake-work-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once: later readers need neither its lineage nor the executors that made it."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
