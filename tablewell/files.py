"""Small files and folders in any store that Spark can write to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write a file that isn't there yet; FileExistsError if it is.

        The text is written under a hidden name and then gets its own in one step that fails if that is taken, so a reader
        sees the whole file or none, and of two writers one wins.
        """
        folder, _, last = name.rpartition("/")
        hidden = f"{folder}/.{last}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(hidden), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if str(self._fs.getUri().getScheme()) == "file":  # a rename replaces there, a link doesn't
                place = lambda n: self._jvm.java.io.File(self._path(n).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(place(name), place(hidden))
            else:
                fs = self._jvm.org.apache.hadoop.fs
                once = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                fs.FileContext.getFileContext(self._path(name).toUri(), self._fs.getConf()).rename(self._path(hidden), self._path(name), once)
        except Exception as e:
            if self.exists(name):
                raise FileExistsError(name) from e
            raise
        finally:
            if self.exists(hidden):
                self._fs.delete(self._path(hidden), False)

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def copy(self, name: str, to: str) -> None:
        conf = self._fs.getConf()
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), self._fs, self._jvm.org.apache.hadoop.fs.Path(to), False, conf)
