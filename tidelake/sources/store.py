"""Small files (logs, metadata) in any store that Hadoop's FileSystem opens; for the driver alone."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, folder: str, deep: bool = False) -> list[tuple[str, int, int]]:
        """(path below the root, size, modification time in ms) of the files in a folder; none if it is missing."""
        if not self.exists(folder):
            return []
        found, out = self.fs.listFiles(self._path(folder), deep), []
        base = self.fs.makeQualified(self._path("")).toString()
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString()[len(base) :].lstrip("/"), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, name: str, data: bytes) -> bool:
        """Create a file whole, or return False if it is there already.

        Written under another name first, then renamed: readers never see part of it. Where
        the store's rename replaces files (local disks), a hard link decides the race.
        """
        import os
        import uuid

        if self.exists(name):
            return False
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(part), True)
        out.write(bytearray(data))
        out.close()
        uri = self.fs.makeQualified(self._path(part)).toUri()
        if uri.getScheme() == "file":
            target = self.fs.makeQualified(self._path(name)).toUri().getPath()
            try:
                os.link(uri.getPath(), target)
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(self._path(part), False)
        done = self.fs.rename(self._path(part), self._path(name))
        if not done:
            self.fs.delete(self._path(part), False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
