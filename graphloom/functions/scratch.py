"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting to remove an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset (local tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def kept_dir(spark: SparkSession) -> str:
    """The folder in the shared one for tables that later applications read too, under names that say what state of
    a source they were made from. sweep() leaves it."""
    return f"{shared_dir(spark)}/graphloom/kept"


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a folder; where another run has put the same table there meanwhile, this one goes."""
    system, found = _file_system(spark, path)
    if exists(spark, to) or not system.rename(found, spark._jvm.org.apache.hadoop.fs.Path(to)):
        system.delete(found, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str = "cut", codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the plan starts anew from files
    that survive the loss of any executor. Results may read these files until sweep(). The shuffle
    files of the write itself are of no more use once the table is there, and are removed."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that cut() has written and that are still there, in order.
_written: list[str] = []


def mark() -> int:
    """A point to discard() from."""
    return len(_written)


def discard(spark: SparkSession, since: int) -> None:
    """Deletes the tables that cut() has written since a mark, but for the last one: for jobs in stages,
    once a stage's result is written."""
    for path in _written[since:-1]:
        system, found = _file_system(spark, path)
        system.delete(found, True)
    del _written[since:-1]


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    system, found = _file_system(spark, path)
    return system.exists(found)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of a table's path, length and last change: another one when the table is another."""
    system, found = _file_system(spark, path)
    state = f"{path}|{system.getContentSummary(found).getLength()}|{system.getFileStatus(found).getModificationTime()}"
    return hashlib.sha256(state.encode()).hexdigest()[:24]


def sweep(spark: SparkSession) -> bool:
    """Deletes this application's intermediate tables, through Spark's own file system. Call it when
    results are written; DataFrames that still read the tables fail afterwards."""
    system, found = _file_system(spark, scratch_dir(spark))
    return system.delete(found, True)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Joins a wide table to a narrow, already materialised one. Counts the narrow side first and
    broadcasts it up to max_rows (keys of some tens of bytes); beyond that both sides are shuffled."""
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    else:
        small = small.hint("merge")
    return big.join(small, on, how)
