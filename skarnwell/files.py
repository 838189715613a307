"""Files and folders on any file system that Spark can reach, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its address: a local path, or one with a scheme such as hdfs:// or s3a://."""

    def __init__(self, spark: SparkSession, address: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(str(address))
        self.fs = self.path.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def make(self) -> None:
        self.fs.mkdirs(self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folders: bool | None = None) -> list[str]:
        """Names in the folder, sorted; only those of folders or of files if asked."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path) if folders is None or s.isDirectory() == folders)

    def read(self, name: str) -> str:
        """The text of a small file."""
        if not self.exists(name):
            raise FileNotFoundError(name)
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes a small file under another name and moves it into place, so that readers see the old or the new one."""
        new = self.at(f".{name}.new")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        where = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        where.rename(self.fs.makeQualified(new), self.fs.makeQualified(self.at(name)), options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def copy_from(self, other: Folder, name: str) -> None:
        self.fs.mkdirs(self.at(name).getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(other.fs, other.at(name), self.fs, self.at(name), False, True, self.conf)
