"""The ledger of processed authors: what was done, and where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.schemas import LEDGER

BATCH_AUTHORS = 5


def upsert(current: DataFrame, changes: DataFrame, key: str = "processing_order",
           sequence: str | None = None) -> DataFrame:
    """Whole-row replace by key, the last change winning.

    ``sequence`` orders several changes of one key; without it a key may change once. A change
    whose sequence is NULL comes before all others, but after the stored row.
    The winner is a ``max`` per key, which combines before the shuffle.
    """
    columns = current.columns
    place = F.lit(0).cast("long") if sequence is None else F.coalesce(F.col(sequence).cast("long"), F.lit(-(2**61)))
    rows = current.select(*columns, F.lit(None).cast("long").alias("_seq")).unionByName(
        changes.select(*columns, place.alias("_seq"))
    )
    rest = [c for c in columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.coalesce("_seq", F.lit(-(2**62)))).alias("_row"))
        .select(key, "_row.*")
        .select(*columns)
    )


def with_defaults(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Missing counts become 0 and a missing date the current time."""
    stamp = F.current_timestamp() if now is None else now
    filled = {"processed_date": F.coalesce("processed_date", stamp)}
    for name in ("raw_books_count", "deduplicated_books_count", "books_found"):
        filled[name] = F.coalesce(name, F.lit(0))
    return rows.withColumns(filled).select(*[F.col(f.name).cast(f.dataType) for f in LEDGER])


def group_counts(df: DataFrame, group: str = "author", name: str = "count") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias(name))


def ids_by_group(df: DataFrame, group: str = "author", id: str = "id") -> DataFrame:
    """The parallel id list, one row per id."""
    return df.select(group, id)


def ledger_rows(authors: DataFrame, raw: DataFrame, kept: DataFrame, now: Column | None = None,
                key: str = "processing_order") -> DataFrame:
    """One ledger row per author of the batch.

    ``authors`` has the key and author_name; ``raw`` are the volumes after the volume
    filter, ``kept`` those left by deduplication, both with the key. Authors without books
    stay.
    """
    raw_counts = group_counts(raw, key, "raw_books_count")
    kept_counts = group_counts(kept, key, "deduplicated_books_count")
    stamp = F.current_timestamp() if now is None else now
    return with_defaults(
        authors.join(raw_counts, key, "left").join(kept_counts, key, "left")
        .withColumn("books_found", (F.coalesce("deduplicated_books_count", F.lit(0)) > 0).cast("int"))
        .withColumn("processed_date", stamp),
        stamp,
    )


def count_mismatch(raw_counts: DataFrame, kept_counts: DataFrame, key: str = "processing_order") -> DataFrame:
    """Keys that have one of the two counts only."""
    r = raw_counts.select(key, F.lit(True).alias("in_raw"))
    k = kept_counts.select(key, F.lit(True).alias("in_kept"))
    return r.join(k, key, "full").where(F.col("in_raw").isNull() | F.col("in_kept").isNull())


def check_counts(raw_counts: DataFrame, kept_counts: DataFrame, key: str = "processing_order") -> None:
    """Raise when a batch's counts do not belong to the same keys."""
    if not count_mismatch(raw_counts, kept_counts, key).isEmpty():
        raise ValueError("raw and deduplicated counts belong to different authors")


def last_processed(ledger: DataFrame, order: str = "processing_order") -> DataFrame:
    """One row with the largest key; NULL for an empty ledger."""
    return ledger.agg(F.max(order).alias("last"))


def resume_point(ledger: DataFrame, reset_from_start: bool = False, zero_is_none: bool = False,
                 order: str = "processing_order") -> Column:
    """First key of the next batch, as a scalar subquery.

    ``zero_is_none`` treats a ledger that ends at key 0 as empty, so key 0 is done again.
    """
    if reset_from_start:
        return F.lit(0)
    last = ledger.agg(F.max(order)).scalar()
    following = F.coalesce(last + 1, F.lit(0))
    return F.when(last == 0, F.lit(0)).otherwise(following) if zero_is_none else following


def next_batch(authors: DataFrame, ledger: DataFrame, size: int = BATCH_AUTHORS,
               order: str = "processing_order", **resume) -> DataFrame:
    """The authors from the resume point on, ``size`` of them; ``resume`` as above."""
    start = resume_point(ledger, order=resume.pop("ledger_order", "processing_order"), **resume)
    return authors.where((F.col(order) >= start) & (F.col(order) < start + size))
