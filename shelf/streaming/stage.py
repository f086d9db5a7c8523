"""Staging as a stream over the landed files: by dates, staged again in full, or by rows, with what was seen kept as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.operators.staging import flatten, stage_rows, stageable
from shelf.schemas import RAW
from shelf.sinks.writers import overwrite_partitions


def stage_stream(
    spark: SparkSession,
    raw_path: str,
    target: str,
    checkpoint: str,
    schema: T.StructType = RAW,
    date: Column | str = "date",
    rows: Callable[[DataFrame], DataFrame] = stage_rows,
    by: str = "processing_date",
    files_per_batch: int | None = None,
    **options: str,
) -> None:
    """Stage whatever landed since the last call, then stop.

    The checkpoint remembers files, not dates, so a late hour of a staged date is taken.
    A batch names the dates it touches and those are staged again in full from the raw
    files: writing a partition from the new files alone would erase its earlier hours.
    Running a batch again gives the same partitions.
    """
    date = F.col(date) if isinstance(date, str) else date
    source = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def stage(batch: DataFrame, _: int) -> None:
        # the driver lists every file of these partitions anyway; named as literals they prune the scan
        dates = [r[0] for r in batch.select(date.alias("_date")).distinct().collect()]
        if not dates:
            return
        session = batch.sparkSession
        whole = session.read.schema(schema).options(**options).parquet(raw_path).where(date.isin(dates))
        overwrite_partitions(rows(whole), target, by)

    query = (
        source.parquet(raw_path)
        .writeStream.foreachBatch(stage)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


#: keeps state on disk, so it is not bound by the memory of the executors
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LateRows(RuntimeError):
    """Rows came later than the stream remembers; they are not staged."""


def flat_rows(raw: DataFrame) -> DataFrame:
    """What staging makes of each row, before repeated rows are dropped."""
    return flatten(stageable(raw))


def append_stream(
    spark: SparkSession,
    raw_path: str,
    target: str,
    checkpoint: str,
    schema: T.StructType = RAW,
    rows: Callable[[DataFrame], DataFrame] = flat_rows,
    by: str = "processing_date",
    delay: str = "90 days",
    files_per_batch: int | None = None,
    state_store: str | None = ROCKSDB,
    **options: str,
) -> int:
    """Stage the rows that landed since the last call, less those staged already, and return how many raw rows were read.

    A row is known by a digest of all its columns, which the state store keeps with its date, so a late hour of a staged date
    adds its rows: neither the date's other raw files nor its partition are read, and nothing written is replaced. Digests of
    dates more than ``delay`` before the latest are forgotten. Rows of such dates raise ``LateRows`` at the end of the call; ``stage_unseen``
    stages dates of any age. ``rows`` works row by row; ``by`` is a date as text. The target must be written by this
    stream alone; its log of files makes each batch count once.
    """
    source = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    flat = rows(source.parquet(raw_path))
    digest = F.unhex(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256))
    marked = flat.select("*", digest.alias("_digest"), F.to_timestamp(by).alias("_day"))
    once = marked.withWatermark("_day", delay).dropDuplicates(["_digest", "_day"]).drop("_digest", "_day")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if state_store:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state_store)
    try:
        query = (
            once.writeStream.format("parquet").partitionBy(by).option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    progress = query.recentProgress
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p["stateOperators"])
    if late:
        raise LateRows(f"{late} rows of dates more than {delay} before the latest; stage their dates with stage_unseen")
    return sum(p["numInputRows"] for p in progress)
