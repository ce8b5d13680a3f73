"""Files by Hadoop path: whatever file system the session knows (local, HDFS, object stores, SFTP, WebDAV connectors)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Small-file operations and directory moves on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getFileStatus(p).getLen()

    def is_dir(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def list(self, path: str) -> list[str]:
        """Names in a directory, sorted; none if it does not exist."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        (a, fs), (b, _) = self._at(old), self._at(new)
        if not fs.rename(a, b):
            raise OSError(f"cannot rename {old} to {new}")

    def copy(self, old: str, new: str) -> None:
        (a, fs), (b, to) = self._at(old), self._at(new)
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, self.spark._jsc.hadoopConfiguration()):
            raise OSError(f"cannot copy {old} to {new}")

    def read(self, path: str) -> bytes:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        p, fs = self._at(path)
        return (self.jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 1000

    def claim(self, path: str) -> bool:
        """Create an empty file; False if it is there already, whoever made it."""
        p, fs = self._at(path)
        try:
            fs.create(p, False).close()
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        return True

    def write(self, path: str, content: bytes) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(content)
        finally:
            stream.close()
