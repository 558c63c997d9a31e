"""Small files on whatever file system holds a root folder."""

from __future__ import annotations

from pyspark.sql import SparkSession


class HadoopFiles:
    """The few small-file operations, on whatever file system holds the root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the target, then rename over it: readers find the old text or the new one."""
        side = f"{path}.tmp"
        stream = self._fs.create(self._path(side), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        how = self._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        target = self._fs.makeQualified(self._path(path))
        context = hadoop.FileContext.getFileContext(target.toUri(), self._conf)
        context.rename(self._fs.makeQualified(self._path(side)), target, how)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
