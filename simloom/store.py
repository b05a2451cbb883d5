"""Stored tables in the folder all executors share, and file operations over Hadoop's interface."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="simloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """frame, written once and read back: it is not computed again, and its rows are counted from the files' footers."""
    path = f"{shared_dir(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Files:
    """The few file operations needed, for any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._of(path)

    def _of(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._of(path).exists(self._path(path))

    def qualified(self, path: str) -> str:
        """path as Spark's readers name it."""
        return self._of(path).makeQualified(self._path(path)).toString()

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._of(path).listStatus(self._path(path))) if self.exists(path) else []

    def files_below(self, path: str, suffix: str = "") -> list[str]:
        """Full paths of all files below path whose name ends with suffix, in order."""
        found, listed = [], self._of(path).listFiles(self._path(path), True)
        while listed.hasNext():
            at = listed.next().getPath()
            if at.getName().endswith(suffix):
                found.append(at.toString())
        return sorted(found)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def read(self, path: str) -> str:
        stream = self._of(path).open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str | bytes) -> None:
        """Make a file that was not there, whole: written beside it and renamed. FileExistsError if it is there."""
        beside = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode() if isinstance(text, str) else text))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        target = self._fs.makeQualified(self._path(path))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(beside), target, self._gateway.new_array(options, 0))
        except Exception as error:
            self._fs.delete(beside, False)
            if self._fs.exists(target):
                raise FileExistsError(path) from error
            raise
