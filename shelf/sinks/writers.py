"""Writing landed books, staging partitions, the ledger and the vector table."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelf.operators.ledger import upsert, with_defaults
from shelf.schemas import LEDGER
from shelf.scratch import delete, materialize

LEDGER_BUCKETS = 16


def land(df: DataFrame, path: str, at: datetime) -> None:
    """Append under ``date=/hour=`` of the given processing time."""
    (
        df.withColumn("date", F.lit(at.strftime("%Y-%m-%d")))
        .withColumn("hour", F.lit(at.strftime("%H")))
        .write.partitionBy("date", "hour").mode("append").parquet(path)
    )


def land_books(books: DataFrame, books_path: str, ids_path: str, at: datetime) -> None:
    """Books, and beside them their ids."""
    land(books, books_path, at)
    land(books.select("id"), ids_path, at)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; dates and times become text."""
    df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(path)


def overwrite_partitions(staged: DataFrame, path: str, by: str = "processing_date") -> None:
    """Replace the partitions that occur in ``staged``; the others stay.

    Rows are rebalanced by partition first: few files per small partition, and a partition
    with very many rows is split over tasks.
    """
    (
        staged.hint("rebalance", F.col(by)).write.partitionBy(by).mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def create_ledger(spark: SparkSession, table: str = "processed_authors") -> None:
    """An empty ledger, partitioned by a hash of its key."""
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], LEDGER).withColumn("bucket", F.lit(0))
        empty.write.partitionBy("bucket").saveAsTable(table)


def save_ledger(spark: SparkSession, changes: DataFrame, table: str = "processed_authors",
                key: str = "processing_order", buckets: int = LEDGER_BUCKETS) -> None:
    """Merge rows into the ledger table, touching only the buckets that the changes fall into.

    A touched bucket's merged rows are written to a folder of their own, and then the bucket's
    location is switched there, so a reader finds the old rows or the new ones, whenever a run dies. The other
    buckets' files stay as they are. ``buckets`` must stay the same over a table's life.
    """
    create_ledger(spark, table)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    changed = materialize(with_defaults(changes).select("*", bucket), "changes")
    touched = sorted(r[0] for r in changed.select("bucket").distinct().collect())  # `buckets` at most
    if not touched:
        return
    columns = LEDGER.fieldNames()
    current = spark.table(table).where(F.col("bucket").isin(touched))
    merged = upsert(current.select(*columns), changed.select(*columns), key)
    version = f"{_location(spark, table)}.versions/{uuid.uuid4().hex}"
    merged.select("*", bucket).repartition("bucket").write.partitionBy("bucket").parquet(version)
    there = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    left = [_location(spark, table, b) for b in touched if f"bucket={b}" in there]
    fresh = [f"PARTITION (bucket={b}) LOCATION '{version}/bucket={b}'" for b in touched if f"bucket={b}" not in there]
    if fresh:
        spark.sql(f"ALTER TABLE {table} ADD {' '.join(fresh)}")
    for b in touched:
        if f"bucket={b}" in there:
            spark.sql(f"ALTER TABLE {table} PARTITION (bucket={b}) SET LOCATION '{version}/bucket={b}'")
    spark.catalog.refreshTable(table)
    for folder in left:  # nothing points there any more
        delete(spark, folder)


def _location(spark: SparkSession, table: str, bucket: int | None = None) -> str:
    """Where a table, or one of its buckets, lies."""
    part = "" if bucket is None else f" PARTITION (bucket={bucket})"
    rows = spark.sql(f"DESCRIBE EXTENDED {table}{part}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def write_vectors(vectors: DataFrame, table: str, mode: str = "append", key: str = "id") -> int:
    """Create the vector table or add to it; returns the number of rows written.

    'append' adds the same ids again when a date range is run twice. 'append_new' leaves out
    ids the table already has; it never changes a stored vector.
    """
    spark = vectors.sparkSession
    if mode not in ("append", "append_new"):
        raise ValueError(f"mode must be 'append' or 'append_new', not {mode!r}")
    exists = spark.catalog.tableExists(table)
    if exists and mode == "append_new":
        vectors = vectors.join(spark.table(table).select(key), key, "left_anti").select(*spark.table(table).columns)
    seen = Observation()
    counted = vectors.observe(seen, F.count(F.lit(1)).alias("rows"))
    if exists:
        counted.write.mode("append").saveAsTable(table)
    else:
        counted.write.saveAsTable(table)
    return int(seen.get["rows"])
