"""Aggregates behind the catalogue dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.text import shorten
from shelf.schemas import DASHBOARD_COLUMNS
from shelf.scratch import materialize



def dashboard_rows(staged: DataFrame) -> DataFrame:
    """The nine dashboard columns with publisher and category cut to label length."""
    return staged.select(*DASHBOARD_COLUMNS).withColumns(
        {
            "publisher": shorten("publisher"),
            "primary_category": shorten(F.lower("primary_category")),
        }
    )


def summary_cards(
    books: DataFrame,
    as_of_year: int,
    rating: str = "avg_rating",
    ratings: str = "ratings_count",
    year: str = "publication_year",
) -> DataFrame:
    """One row: number of books, ratings given, mean rating, latest year and the card texts.

    The mean runs over every row, unrated ones count as what staging stored for them.
    """
    totals = books.agg(
        F.count(F.lit(1)).alias("total_books"),
        F.sum(ratings).alias("ratings_count"),
        F.avg(rating).alias("avg_rating"),
        F.least(F.max(year), F.lit(as_of_year)).alias("latest_year"),
    )
    return totals.select(
        "*",
        F.format_number("total_books", 0).alias("total_books_text"),
        F.format_number("avg_rating", 1).alias("avg_rating_text"),
    )


def label_counts(books: DataFrame, label: Column | str) -> DataFrame:
    """Books per label, NULL labels left out."""
    label = F.col(label) if isinstance(label, str) else label
    return (
        books.select(label.alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_labels(books: DataFrame, label: Column | str, n: int = 8) -> DataFrame:
    """The ``n`` most frequent labels, ties by name."""
    return label_counts(books, label).orderBy(F.desc("count"), "label").limit(n)


def share_filter(
    books: DataFrame, label: Column | str, share: float = 0.02, keep_other: bool = False
) -> DataFrame:
    """Labels that hold at least ``share`` of all books.

    The rest is left out, or added up as one 'Other' row with ``keep_other``. The books are
    read once: the total, which includes books without a label, is summed over the counts.
    """
    label = F.col(label) if isinstance(label, str) else label
    every = materialize(books.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count")), "label-counts")
    total = every.agg(F.sum("count")).scalar()
    counts = every.where(F.col("label").isNotNull())
    large = F.col("count") >= total * F.lit(share)
    if not keep_other:
        return counts.where(large)
    return (
        counts.withColumn("label", F.when(large, F.col("label")).otherwise("Other"))
        .groupBy("label")
        .agg(F.sum("count").alias("count"))
    )


def per_year(books: DataFrame, year: str = "publication_year") -> DataFrame:
    """Books per year, ascending; rows without a year are left out."""
    return (
        books.where(F.col(year).isNotNull())
        .groupBy(F.col(year).alias("publication_year"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("publication_year")
    )


def rating_histogram(books: DataFrame, rating: str = "avg_rating", bins: int = 10, top: float = 5.0) -> DataFrame:
    """Books per rating bin on [0, top]; the last bin is closed."""
    width = top / bins
    bucket = F.least(F.floor(F.col(rating) / width), F.lit(bins - 1)).cast("int")
    return (
        books.where(F.col(rating).isNotNull())
        .groupBy(bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (F.col("bin") * width).alias("bin_start"), "count")
        .orderBy("bin")
    )


def newest_first(books: DataFrame, year: str = "publication_year", ties: tuple[str, ...] = ("title",)) -> DataFrame:
    """Newest year first, rows without a year last."""
    return books.orderBy(F.desc_nulls_last(year), *ties)


def newest_rows(books: DataFrame, n: int = 5, year: str = "publication_year",
                ties: tuple[str, ...] = ("title",)) -> DataFrame:
    """The first ``n`` rows of that order."""
    return newest_first(books, year, ties).limit(n)


def highlight(books: DataFrame, rating: str = "avg_rating", above: float = 4.0) -> DataFrame:
    """Flag rows rated above the mark, with the rating as the table prints it."""
    return books.withColumns(
        {
            "highlight": F.coalesce(F.col(rating) > above, F.lit(False)),
            "rating_text": F.format_number(F.col(rating), 1),
        }
    )
