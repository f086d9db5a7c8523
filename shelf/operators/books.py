"""Staged rows to the frame the vectors are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.functions.text import clean_text, is_blank
from shelf.schemas import CLEAN_COLUMNS

# fixed values: columns whose stand-ins for "nothing" stay as they are
KEPT_AS_IS = ("id", "description", "title", "avg_rating", "ratings_count")


def nothing_to_null(field: T.StructField) -> Column:
    """0 or '' back to NULL, by the column's type."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(field.dataType, T.IntegralType):
        return F.nullif(c, F.lit(0).cast(field.dataType))
    if isinstance(field.dataType, T.FractionalType):
        return F.nullif(c, F.lit(0.0).cast(field.dataType))
    return c


def null_sentinels(staged: DataFrame, keep: tuple[str, ...] = KEPT_AS_IS) -> DataFrame:
    """NULL where staging put a stand-in, and for the rating of a never rated book."""
    out = []
    for field in staged.schema.fields:
        if field.name == "avg_rating" and "ratings_count" in staged.columns:
            unrated = F.col("ratings_count").eqNullSafe(F.lit(0))
            out.append(F.when(~unrated, F.col("avg_rating")).alias("avg_rating"))
        elif field.name in keep:
            out.append(F.col(field.name))
        else:
            out.append(nothing_to_null(field).alias(field.name))
    return staged.select(*out)


def clean_books(staged: DataFrame) -> DataFrame:
    """The fourteen book columns, stand-ins undone and the description cleaned."""
    books = null_sentinels(staged.select(*CLEAN_COLUMNS))
    return books.withColumn("description", clean_text("description"))


def with_text(books: DataFrame, text: str = "description") -> DataFrame:
    """Add ``processed_text`` and drop rows without any; no such column, no rows."""
    if text not in books.columns:
        return books.withColumn("processed_text", F.lit("")).where(F.lit(False))
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # one element or none: unlike a filter this is not pushed below the cleaning, which
    # would then run twice
    kept = F.filter(F.array(filled), lambda t: ~is_blank(t))
    return books.select("*", F.explode(kept).alias("processed_text"))
