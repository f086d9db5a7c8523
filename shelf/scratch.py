"""Intermediate tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local-mode session may go without one; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    already = context.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="shelf-scratch-")
    context.setCheckpointDir(own)
    return own


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{scratch_root(spark)}/shelf/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Drop what this application has written to the shared folder.

    For the owner of the session, once the results are written: frames that still read intermediate
    tables cannot be used any more. Databases that lie in the folder go with their tables.
    """
    folder = run_folder(spark)
    for database in spark.catalog.listDatabases():
        if database.locationUri and folder in database.locationUri:
            spark.sql(f"DROP DATABASE {database.name} CASCADE")
    delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder and all in it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


# the tables written inside each open ``temporary`` block, innermost last
_open: list[list[str]] = []


# Spark drops the shuffle files of a query as soon as it ends, not when the driver happens to collect its garbage
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def temporary(spark: SparkSession, shuffles: bool = False) -> Iterator[None]:
    """Tables that ``materialize`` writes inside the block are dropped at its end.

    What the block hands on must be written with ``lasting``, for frames are lazy; it then belongs to the block
    around this one, if there is any. With ``shuffles`` the shuffle files of each query that runs inside go when it ends.
    """
    mine: list[str] = []
    _open.append(mine)
    before = spark.conf.get(SHUFFLES_GO, None)
    if shuffles:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if shuffles and before is None:
            spark.conf.unset(SHUFFLES_GO)
        elif shuffles:
            spark.conf.set(SHUFFLES_GO, before)
        _open.remove(mine)
        for path in mine:
            delete(spark, path)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, lasting: int = 0,
                codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    ``lasting``: how many ``temporary`` blocks the table outlives; ``codec``: how its files are compressed, if not as set.

    Compared with ``checkpoint()`` the plan runs once instead of twice, and the
    reader knows the table's size, so later joins can choose to broadcast it.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _open[:max(0, len(_open) - lasting)]
    if owners:
        owners[-1].append(path)
    writer = df.write.mode("error")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over at least as many tasks as there are cores.

    A file of one row group is read by one task. Only a scan that has fewer partitions
    than the session has cores is moved, so a large table is never shuffled by this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
