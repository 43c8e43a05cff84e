"""Folders that are published in versions: data first, then a mark ``COMMIT/<n>``."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Publication:
    """A folder of versions; a version without its mark was never finished and is not read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, folder = self._folder(path)
        return fs.exists(folder)

    def _clear(self, path: str) -> None:
        fs, folder = self._folder(path)
        fs.delete(folder, True)

    def _commit(self, version: int) -> None:
        fs, mark = self._folder(f"{self.path}/COMMIT/{version}")
        fs.create(mark, True).close()

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        fs, folder = self._folder(f"{self.path}/COMMIT")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)
