"""Staged partitions to the vector table, and questions to cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelf.functions.encode import Encoder, hashing_encoder
from shelf.operators.books import clean_books, with_text
from shelf.operators.vectors import LIMIT, embed, result_cards, search
from shelf.sinks.writers import write_vectors
from shelf.sources.readers import staged_files


def vectorize(staged: DataFrame, make: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """Clean staged rows, drop those without text and add their vectors."""
    if "description" not in staged.columns:
        return embed(with_text(staged), make=make)
    return embed(with_text(clean_books(staged)), make=make)


def build_vectors(
    spark: SparkSession,
    staged_path: str,
    start_date: str,
    end_date: str,
    table: str = "vectors",
    mode: str = "append",
    make: Callable[[], Encoder] = hashing_encoder,
) -> int:
    """Vectors of a date range into the table; returns how many rows were written."""
    rows = staged_files(spark, staged_path, start_date, end_date)
    if rows.isEmpty():
        return 0
    return write_vectors(vectorize(rows, make), table, mode)


def recommend(vectors: DataFrame, queries: DataFrame, limit: int = LIMIT,
              make: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """Question texts (qid, query) to the cards of the nearest books."""
    return result_cards(search(vectors, queries, limit, make=make), vectors)
