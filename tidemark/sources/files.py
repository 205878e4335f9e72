"""Small files and folders on any file system that Spark reaches, without Spark jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system of the folder ``root``; paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs
        self._path, self._io = hadoop.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        kind = getattr(hadoop, "Options$Rename")
        self._over = spark.sparkContext._gateway.new_array(kind, 1)
        self._over[0] = kind.OVERWRITE

    def at(self, name: str):  # noqa: ANN201  a Java object
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self.at(name)))

    def text(self, name: str) -> str | None:
        """The text of a file; none if there is no such file."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self.at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """Puts ``text`` in place of the file in one step: readers see the old text or the new one."""
        new = self.at(f"{name}.next-{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self.at(name)), self._over)

    def folders(self, name: str = "") -> list[str]:
        """Names of the folders in a folder, in order; none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name)) if s.isDirectory())

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self.at(name), True))

    def size(self, name: str) -> tuple[int, int]:
        """Files and bytes under a folder."""
        told = self._fs.getContentSummary(self.at(name))
        return told.getFileCount(), told.getLength()
