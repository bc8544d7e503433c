"""Folder moves through the file system Spark itself writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        handle = self._jvm.org.apache.hadoop.fs.Path(path)
        return handle.getFileSystem(self._conf), handle

    def exists(self, path: str) -> bool:
        fs, handle = self._open(path)
        return fs.exists(handle)

    def make(self, path: str, delete_on_exit: bool = False) -> None:
        fs, handle = self._open(path)
        fs.mkdirs(handle)
        if delete_on_exit:
            fs.deleteOnExit(handle)

    def folders(self, path: str) -> list[str]:
        """Names of the direct subfolders, leaving out hidden and underscore ones."""
        fs, handle = self._open(path)
        if not fs.exists(handle):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(handle) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def names(self, path: str) -> list[str]:
        """Names of the direct entries, leaving out hidden ones."""
        fs, handle = self._open(f"{path}/*")
        return sorted(n for s in (fs.globStatus(handle) or []) if not (n := s.getPath().getName()).startswith("."))

    def stamp(self, path: str) -> tuple:
        """Name, size and time of a file, or of the direct entries of a folder: differs when they are written anew."""
        fs, handle = self._open(path)
        return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(handle)))

    def leaves(self, path: str, depth: int) -> list[str]:
        """Relative folders ``depth`` levels below ``path`` that are partition values; "" for depth 0 when there are files."""
        fs, handle = self._open(path)
        if not depth:
            return [""] if any(n.startswith("part-") for n in self.names(path)) else []
        root = fs.makeQualified(handle).toUri().getPath().rstrip("/") + "/"
        found = fs.globStatus(self._jvm.org.apache.hadoop.fs.Path(handle, "/".join(["*=*"] * depth))) or []
        return sorted(s.getPath().toUri().getPath().removeprefix(root) for s in found)

    def read_text(self, path: str) -> str:
        fs, handle = self._open(path)
        stream = fs.open(handle)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        fs, handle = self._open(path)
        stream = fs.create(handle, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def encoded_path(self, path: str) -> str:
        """The absolute path as it stands in URIs, without its file system."""
        fs, handle = self._open(path)
        return fs.makeQualified(handle).toUri().getRawPath().rstrip("/")

    def parquet_schema(self, path: str) -> str:
        """The schema in the footer of a Parquet file, or of the first one in a folder."""
        fs, handle = self._open(path)
        status = fs.getFileStatus(handle)
        if status.isDirectory():
            data = [s for s in fs.listStatus(handle) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
            if not data:
                return ""
            status = min(data, key=lambda s: s.getPath().getName())
        source = self._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, self._conf)
        reader = self._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            return reader.getFooter().getFileMetaData().getSchema().toString()
        finally:
            reader.close()

    def glob(self, pattern: str) -> list[str]:
        fs, handle = self._open(pattern)
        return sorted(s.getPath().toString() for s in (fs.globStatus(handle) or []))

    def move(self, source: str, target: str) -> None:
        fs, handle = self._open(source)
        goal = self._jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(goal.getParent())
        if not fs.rename(handle, goal):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, path: str) -> None:
        fs, handle = self._open(path)
        fs.delete(handle, True)
