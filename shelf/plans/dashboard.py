"""Every aggregate of the dashboard over the staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelf.operators import stats
from shelf.scratch import materialize


def dashboard(staged: DataFrame, as_of_year: int) -> dict[str, DataFrame]:
    books = materialize(stats.dashboard_rows(staged), "dashboard")  # six panels, one pass over the staged rows
    return {
        "summary": stats.summary_cards(books, as_of_year),
        "per_year": stats.per_year(books),
        "publishers": stats.top_labels(books, "publisher"),
        "categories": stats.share_filter(books, "primary_category"),
        "ratings": stats.rating_histogram(books),
        "newest": stats.highlight(stats.newest_rows(books)),
    }
