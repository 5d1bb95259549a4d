"""Files of a table in whatever store Hadoop reads: what appending and overwriting need beyond Spark's writers."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def touch(self, path: str) -> None:
        self._fs.create(self._at(path), True).close()

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} can't be renamed to {new}")
