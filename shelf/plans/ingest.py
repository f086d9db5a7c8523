"""Landed pages of one author batch to landed books and ledger rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.operators.descriptions import description_dedup
from shelf.operators.ledger import check_counts, ledger_rows, next_batch
from shelf.operators.titles import title_dedup
from shelf.operators.volumes import INGEST_PAGES, author_volumes
from shelf.schemas import LEDGER
from shelf.scratch import materialize
from shelf.sinks.writers import create_ledger, land_books, save_ledger


def deduplicate_books(books: DataFrame, group: str = "author", order: str = "ord") -> DataFrame:
    """Title rule, then description rule, per author."""
    flat = books.withColumns({"_title": F.col("volumeInfo.title"), "_text": F.col("volumeInfo.description")})
    by_title = materialize(title_dedup(flat, group, order, "_title"), "by-title")
    return description_dedup(by_title, group, order, "_text").drop("_title", "_text")


def ingest_batch(
    spark: SparkSession,
    authors: DataFrame,
    pages: DataFrame,
    books_path: str,
    ids_path: str,
    ledger: str = "processed_authors",
    batch_size: int = 5,
    max_pages: int = INGEST_PAGES,
    at: datetime | None = None,
    reset_from_start: bool = False,
) -> DataFrame:
    """Process the next authors of the list and return their ledger rows.

    The ledger is written last: a run that dies before is done again by the next.
    """
    at = at or datetime.now()
    create_ledger(spark, ledger)
    batch = next_batch(authors, spark.table(ledger), batch_size, reset_from_start=reset_from_start)
    batch = materialize(batch, "batch")
    # by place in the list, not by name: an author listed twice is done twice
    own = pages.join(batch.select("processing_order", F.col("author_name").alias("author")), "author")
    raw = materialize(author_volumes(own, max_pages, group="processing_order"), "raw")
    kept = materialize(deduplicate_books(raw, "processing_order"), "kept")
    land_books(kept.select("id", "volumeInfo", "saleInfo"), books_path, ids_path, at)
    rows = materialize(ledger_rows(batch, raw, kept, F.lit(at)), "ledger").select(*LEDGER.fieldNames())
    check_counts(batch, rows)
    save_ledger(spark, rows, ledger)
    return rows
