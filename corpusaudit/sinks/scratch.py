"""Scratch tables in the folder that all executors share: one rule for every part of the library."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go as soon as their execution has ended; else they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors all run in this process gets a temporary folder, which
    goes when the process ends; any other session is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What an execution in here shuffles is deleted when it has ended: only for tables that nobody asks twice."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table, written once and read from there: short lineage, pruned columns, the same rows at each read. What the write
    shuffled is deleted when it has ended, as nothing reads it again."""
    spark = table.sparkSession
    path = fresh_path(spark, name)
    with freed(spark):
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    spark = table.sparkSession
    root = shared_folder(spark)
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if folder.replace("file:///", "/").startswith(root.replace("file://", "")):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
