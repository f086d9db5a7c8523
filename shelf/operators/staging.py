"""Nested raw volumes to the flat staging table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.functions.values import first_or, or_default, publication_year, published_date
from shelf.schemas import STAGING

# fixed values: what staging writes where the source has nothing
DEFAULTS = {
    "subtitle": "",
    "publisher": "Unknown Publisher",
    "description": "",
    "page_count": 0,
    "avg_rating": 0.0,
    "ratings_count": 0,
    "thumbnail_url": "",
    "language": "en",
    "preview_link": "",
    "sale_country": "US",
    "saleability": "NOT_FOR_SALE",
    "list_price": 0.0,
    "currency": "USD",
    "buy_link": "",
}
NO_AUTHOR, NO_CATEGORY = "Unknown Author", "Uncategorized"
MIN_DESCRIPTION = 100

# staging column -> path in the raw struct, for columns taken as they are or with a default
PATHS = {
    "title": "volumeInfo.title",
    "subtitle": "volumeInfo.subtitle",
    "all_authors": "volumeInfo.authors",
    "publisher": "volumeInfo.publisher",
    "description": "volumeInfo.description",
    "page_count": "volumeInfo.pageCount",
    "all_categories": "volumeInfo.categories",
    "avg_rating": "volumeInfo.averageRating",
    "ratings_count": "volumeInfo.ratingsCount",
    "thumbnail_url": "volumeInfo.imageLinks.thumbnail",
    "language": "volumeInfo.language",
    "preview_link": "volumeInfo.previewLink",
    "sale_country": "saleInfo.country",
    "saleability": "saleInfo.saleability",
    "list_price": "saleInfo.listPrice.amount",
    "currency": "saleInfo.listPrice.currencyCode",
    "buy_link": "saleInfo.buyLink",
}


def stageable(raw: DataFrame, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Raw rows that staging accepts; the date bounds prune partitions."""
    info = F.col("volumeInfo")
    keep = (
        F.col("id").isNotNull()
        & info["title"].isNotNull()
        & (F.size(info["authors"]) > 0)
        & (F.length(F.coalesce(info["description"], F.lit(""))) > MIN_DESCRIPTION)
        & info["publishedDate"].isNotNull()
        & (info["publishedDate"] != "")
    )
    if start_date is not None:
        keep = keep & (F.col("date") >= start_date)
    if end_date is not None:
        keep = keep & (F.col("date") <= end_date)
    return raw.where(keep)


def _staged(name: str) -> Column:
    if name == "primary_author":
        c = first_or("volumeInfo.authors", NO_AUTHOR)
    elif name == "primary_category":
        c = first_or("volumeInfo.categories", NO_CATEGORY)
    elif name == "published_date":
        c = published_date("volumeInfo.publishedDate")
    elif name == "publication_year":
        c = publication_year("volumeInfo.publishedDate")
    elif name == "processing_date":
        c = F.col("date")
    elif name == "id":
        c = F.col("id")
    elif name in DEFAULTS:
        c = or_default(PATHS[name], DEFAULTS[name])
    else:
        c = F.col(PATHS[name])
    return c.alias(name)


def flatten(raw: DataFrame) -> DataFrame:
    """Struct fields to typed columns in staging order, defaults filled in."""
    return raw.select(*[_staged(name) for name in STAGING.fieldNames()])


def stage_rows(
    raw: DataFrame,
    start_date: str | None = None,
    end_date: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, flatten and drop repeated rows. ``limit`` is off unless asked for."""
    rows = flatten(stageable(raw, start_date, end_date)).distinct()
    return rows if limit is None else rows.limit(limit)


def newer_than(raw: DataFrame, target: DataFrame | None, mark: str = "processing_date",
               date: str = "date", on_late: str = "drop") -> DataFrame:
    """Rows past the high-water mark of ``target``; all rows when there is no target.

    'drop' takes strictly newer dates only, so an empty target gives a NULL mark and
    no rows. 'reprocess' takes the mark's own date again, and everything from an empty target.
    """
    if target is None:
        return raw
    latest = target.agg(F.max(mark)).scalar()
    if on_late == "drop":
        return raw.where(F.col(date) > latest)
    if on_late == "reprocess":
        return raw.where(F.col(date) >= F.coalesce(latest, F.lit("")))
    raise ValueError(f"on_late must be 'drop' or 'reprocess', not {on_late!r}")


def latest_by_id(staged: DataFrame, key: str = "id", version: str = "processing_date") -> DataFrame:
    """One row per key, the newest. Staging itself keeps a key once per date."""
    others = [c for c in staged.columns if c not in (key, version)]
    newest = F.max(F.struct(version, *others)).alias("_row")
    return staged.groupBy(key).agg(newest).select(key, "_row.*").select(*staged.columns)
