"""Reading, materialising and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it, a finished query drops its shuffle files.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once, and how many whole texts do: they are held several times there and in the JVM.
AT_ONCE, TEXTS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("callmark.shared.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="callmark-")
        spark.conf.set("callmark.shared.dir", place)
    return place


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in one folder per application, which may go as a whole once the application has ended."""
    return os.path.join(shared_dir(spark), f"callmark-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The shuffle files of the write go when it has ended, since nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and that no later step reads."""
    spark = df.sparkSession
    folder = f"callmark-{spark.sparkContext.applicationId}"
    for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if place.rsplit("/", 2)[-2] != folder:
            raise ValueError(f"{place} is no intermediate table")
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends at most TEXTS_AT_ONCE rows to Python at once."""
    before = spark.conf.get(AT_ONCE)
    spark.conf.set(AT_ONCE, TEXTS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(AT_ONCE, before)


def in_small_batches(f: Callable) -> Callable:
    """f(df, ...) with small_batches."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kwargs):
        with small_batches(df.sparkSession):
            return f(df, *args, **kwargs)

    return run


def own_name(df: DataFrame, name: str) -> str:
    """A name for a working column that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it within other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.lru_cache(maxsize=1)
def in_worker(make: Callable, *args):
    """make(*args), which a Python worker keeps for later tasks until another operator keeps its own: never what two of them remember."""
    return make(*args)


def forget() -> None:
    """Drop what an earlier operator left in this Python worker."""
    in_worker.cache_clear()


class Remembered:
    """What a Python worker remembers of short byte strings, in two generations: when the newer is full, the older goes.

    At most 2 x most entries with keys of at most LONG bytes stay; longer ones are known during one step only.
    """

    LONG = 64

    def __init__(self, most: int):
        self.most, self.now, self.older, self.long = most, {}, {}, []

    def missing(self, wanted: set[bytes]) -> list[bytes]:
        """A new step: those of wanted that are not known; all others are in `now` afterwards."""
        for w in self.long:
            self.now.pop(w, None)
        self.long = []
        if len(self.now) > self.most:
            self.older, self.now = self.now, {}
        return self.also_missing(wanted)

    def also_missing(self, wanted: set[bytes]) -> list[bytes]:
        """The same for more of them within a step."""
        out, now, older = [], self.now, self.older
        for w in wanted.difference(now):
            value = older.get(w)
            if value is None:
                out.append(w)
            else:
                now[w] = value
        self.long += [w for w in out if len(w) > self.LONG]
        return out
