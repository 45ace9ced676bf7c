"""Small files and folders on whatever file system a path names, through Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; of a folder that doesn't exist, none."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def read_text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, src: str, dst: str) -> bool:
        """Rename, atomically, unless dst exists; True if it was done."""
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(src).getFileSystem(self._conf).getUri(), self._conf)
        try:
            context.rename(self._path(src), self._path(dst), self._gateway.new_array(rename, 0))
        except Exception as e:
            if self.exists(dst):
                return False
            raise e
        return True

    def rename_over(self, src: str, dst: str) -> None:
        """Rename, atomically, over dst if it exists."""
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(src).getFileSystem(self._conf).getUri(), self._conf)
        context.rename(self._path(src), self._path(dst), how)
