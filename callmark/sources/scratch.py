"""Intermediate tables that are used more than once, written into the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: With it, a finished query drops its shuffle files.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once, where they are held several times.
AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def place(spark: SparkSession, name: str) -> str:
    """A new path in one folder per application within spark.checkpoint.dir (a temporary folder only in local mode)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("callmark.scratch.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="callmark-")
        spark.conf.set("callmark.scratch.dir", shared)
    return os.path.join(shared, f"callmark-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """What is run within has this setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(spark: SparkSession):
    """The shuffle files of what is written within go when it has ended."""
    return setting(spark, RELEASE, "true")


def written(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, planned and computed once.  at_once: rows that go to Python at once."""
    spark = df.sparkSession
    path = place(spark, name)
    with released(spark), setting(spark, AT_ONCE, str(at_once)) if at_once else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, *names: str) -> None:
    """Delete the tables of these names that written() made and that df reads: for when df has been written and no other step reads them."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        above, own = folder.rsplit("/", 2)[-2:]
        if above == f"callmark-{spark.sparkContext.applicationId}" and own.rsplit("-", 1)[0] in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
