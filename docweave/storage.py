"""The folder that driver and executors share, and small files in any file system that Spark reads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one is set only where none is, in a session of one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints/docweave"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/docweave-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new name in it."""
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


class FileExists(OSError):
    pass


class Files:
    """A few small files, from the driver."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write, over what is there."""
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write_new(self, path: str, data: bytes) -> None:
        """A file that appears whole, or FileExists where there is one: written under another name, then moved without overwriting."""
        fs, p = self._at(path)
        temp = f"{p.getParent()}/.{uuid.uuid4().hex}"
        self.write(temp, data)
        source = self._at(temp)[1]
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(source), fs.makeQualified(p), options)
        except Exception as e:
            fs.delete(source, False)
            if "FileAlreadyExistsException" in str(e):
                raise FileExists(path) from None
            raise

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        return [name for name, _, _ in self.listed(path)]

    def listed(self, path: str) -> list[tuple[str, int, bool]]:
        """(name, bytes, is a file) of a folder's entries, by name."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.isFile()) for s in fs.listStatus(p))

    def age_ms(self, path: str) -> int:
        """Milliseconds since a file or folder was last changed, by this driver's clock."""
        fs, p = self._at(path)
        return self.spark._jvm.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()

    def copy(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to, q = self._at(target)
        conf = self.spark._jsc.hadoopConfiguration()
        if not self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, True, conf):
            raise OSError(f"could not copy {source} to {target}")

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
