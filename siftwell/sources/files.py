"""Small files on any file system that Spark reaches, and the folder for engine data."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


class Files:
    """Listing, reading and atomically writing small files through Hadoop's file system API."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes beside path, then renames: readers see the whole file or none. An existing file is an error."""
        fs, p = self._at(path)
        if fs.exists(p):
            raise FileExistsError(path)
        _, part = self._at(path + ".pending")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(part, p):
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A folder shared by driver and executors: spark.checkpoint.dir; without it the warehouse, or a temporary one locally."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        local = spark.sparkContext.master.split("[")[0] == "local"
        at = "file://" + tempfile.mkdtemp(prefix="siftwell-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siftwell"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
