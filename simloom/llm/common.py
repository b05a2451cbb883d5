"""Helpers shared by the operators: shared-folder tables, size-checked broadcasts, text expressions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower ASCII letters, for lower-casing A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A side is broadcast only when it was counted to have at most this many rows and bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="simloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables that this process has stored in the shared folder.
_stored: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows in the jobs that run inside, to bound workers' memory for long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = jvm_path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _stored.remove(path)


@contextmanager
def tidied(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Delete the tables stored inside, but those with a label in kept, when the block ends without an error.

    For work whose results no longer read them: they were written, or read the kept ones alone.
    """
    before = len(_stored)
    yield
    _delete(spark, [p for p in _stored[before:] if p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in kept])


def clean(spark: SparkSession) -> None:
    """Delete the stored tables of this process. Results that were not written yet cannot be read after it."""
    _delete(spark, list(_stored))


_WIDE = re.compile("string|binary|array|map")


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most `rows` (BROADCAST_ROWS) rows and BROADCAST_BYTES of them.

    Else it is returned as it is, for a shuffle join. Bytes are counted as JSON where a column's width is not fixed.
    Call it on stored tables only: the counts read the table.
    """
    if df.count() > (BROADCAST_ROWS if rows is None else rows):
        return df
    if _WIDE.search(df.schema.simpleString()):
        held = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
        if held > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def sha_hex(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("string"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
