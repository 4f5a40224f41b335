"""Files and folders on any storage that Spark reads, by path: what a job needs around its tables. Runs on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

STAT = "path string, name string, size bigint, folder boolean, modified bigint, mode string"


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._jvm = spark, spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    @staticmethod
    def _row(s) -> tuple:
        at = s.getPath()
        return at.toString(), at.getName(), s.getLen(), s.isDirectory(), s.getModificationTime(), s.getPermission().toString()

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def stat(self, path: str) -> dict:
        at, fs = self._at(path)
        return dict(zip((c.split()[0] for c in STAT.split(", ")), self._row(fs.getFileStatus(at))))

    def list(self, path: str, recursive: bool = False) -> DataFrame:
        """A row of STAT an entry of a folder; of all files below it if recursive."""
        at, fs = self._at(path)
        if not recursive:
            rows = [self._row(s) for s in fs.listStatus(at)]
        else:
            rows, entries = [], fs.listFiles(at, True)
            while entries.hasNext():
                rows.append(self._row(entries.next()))
        return self.spark.createDataFrame(sorted(rows), STAT)

    def glob(self, pattern: str) -> DataFrame:
        at, fs = self._at(pattern)
        return self.spark.createDataFrame(sorted(self._row(s) for s in fs.globStatus(at) or []), STAT)

    def read(self, path: str, start: int = 0, size: int | None = None) -> bytes:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            stream.seek(start)
            left = fs.getFileStatus(at).getLen() - start
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, left if size is None else min(size, left)))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        at, fs = self._at(path)
        stream = fs.create(at, overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def append(self, path: str, data: bytes) -> None:
        """Writes the file again with data behind it, as not every storage can append."""
        self.write(path, (self.read(path) if self.exists(path) else b"") + data)

    def truncate(self, path: str, size: int = 0) -> None:
        self.write(path, self.read(path, 0, size).ljust(size, b"\0"))

    def make_folder(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.mkdirs(at)

    def temporary_folder(self, prefix: str) -> str:
        path = f"{prefix}{uuid.uuid4().hex}"
        self.make_folder(path)
        return path

    def copy(self, source: str, target: str, overwrite: bool = True) -> bool:
        (a, fs_a), (b, fs_b) = self._at(source), self._at(target)
        return self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, overwrite, self._conf)

    def rename(self, source: str, target: str) -> bool:
        (a, fs), (b, _) = self._at(source), self._at(target)
        return fs.rename(a, b)

    def remove(self, path: str, recursive: bool = False) -> bool:
        at, fs = self._at(path)
        return fs.delete(at, recursive)

    def set_mode(self, path: str, mode: str) -> None:
        """mode in octal digits."""
        at, fs = self._at(path)
        fs.setPermission(at, self._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))

    def set_times(self, path: str, modified: int, accessed: int = -1) -> None:
        """Milliseconds; -1 leaves a time as it is."""
        at, fs = self._at(path)
        fs.setTimes(at, modified, accessed)
