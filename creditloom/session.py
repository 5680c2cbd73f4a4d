"""Session defaults and the few helpers that need the session itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "creditloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the jobs are written for.

    ANSI mode stays on. AQE coalesces small shuffles, splits skewed joins and turns a shuffled join
    into a broadcast one when the measured side is small. On a cluster the number of shuffle
    partitions belongs to the submit command; it is only set here through ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an error,
    because a folder on one machine is lost with that machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = configured or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="creditloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """New, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_side(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows of ``df``.

    Meant for lookup tables read from files (price index, unemployment series). When the table is larger
    than the bound the hint is left out, and the join is shuffled like any other.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def held_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A table that other rows are joined with: worked out once and written; with a broadcast hint if it has at most ``max_rows`` rows."""
    done = written(df, "side")
    return F.broadcast(done) if done.limit(max_rows + 1).count() <= max_rows else done


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later reads neither compute it again nor depend on one executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a task of their own in a fit of many short jobs.
TASK_ROWS = 1 << 15


def cut_off(df: DataFrame, packed: bool = False) -> DataFrame:
    """``df`` worked out once, with its rows in the same partitions, and without its past: a fit of many short jobs would ship that past with every task.

    ``packed`` joins partitions to one for each ``TASK_ROWS`` rows, and to one for each core if that is fewer and gives none more than 32 times as many: a job over
    partitions of a few rows is mostly the starting of its tasks.
    Rows go to the checkpoint folder in the shared folder; they are kept in memory only while they are written, because a plan that is kept has its partitions fixed.
    """
    spark = df.sparkSession
    shared_dir(spark)
    df = df.persist()
    try:
        if not packed:
            return df.checkpoint()
        rows = df.count()
        parts = min(-(-rows // TASK_ROWS), max(spark.sparkContext.defaultParallelism, -(-rows // (32 * TASK_ROWS))))
        return df.coalesce(max(1, parts)).checkpoint()
    finally:
        df.unpersist()
