"""Session set-up and the few places where a job has to touch shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def local_session(cpus: str = "*", app: str = "skymill") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode a fresh one where that is unset.

    A cluster must name its folder: a path made up here would be a different disk on every executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(current)
    return current


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and hand back its reader.

    This drops the lineage, so a lost executor loses nothing. A written table also brings its true size to the
    planner: a checkpointed frame keeps the size guessed for its old plan, and in iterated self-joins that guess
    squares every round until planning itself takes seconds. What was shuffled for the table is deleted as soon as it
    is written: otherwise shuffles stay on disk until the driver happens to collect garbage, and a job of many steps
    holds those of all of them.
    """
    path = scratch_path(df.sparkSession, "step")
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions.

    For stages whose rows are few bytes but much work (about to be exploded or compared): the stated number keeps
    adaptive execution from merging them into one task by size. A following join on the same keys reuses the layout.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never broadcast.

    For tables that grow with the input. The planner takes a written table for the size of its file and exploded rows for the
    size of what they come from; columns of few values take a twentieth of their size in a file, so a table of millions
    of rows can pass for small and be collected by the driver.
    """
    return df.hint("merge")


def renew(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for joining a table with its own descendants."""
    return df.select([F.col(f"`{c}`").alias(c) for c in df.columns])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path for a written intermediate table; ``release`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that nothing reads any more: steps of a job that are written anew each round."""
    for df in tables:
        spark = df.sparkSession
        _WRITTEN.remove(df._written)
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far in this process; returns how many.

    For the end of a job, after its result is stored: frames that still read these tables are of no use afterwards.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
