"""Declared schemas of the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _DBL = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VOLUME_INFO = _struct(
    title=_STR,
    subtitle=_STR,
    authors=T.ArrayType(_STR),
    publisher=_STR,
    publishedDate=_STR,
    description=_STR,
    pageCount=_INT,
    categories=T.ArrayType(_STR),
    averageRating=_DBL,
    ratingsCount=_INT,
    imageLinks=_struct(thumbnail=_STR),
    language=_STR,
    previewLink=_STR,
)
SALE_INFO = _struct(
    country=_STR,
    saleability=_STR,
    listPrice=_struct(amount=_DBL, currencyCode=_STR),
    buyLink=_STR,
)
VOLUME = _struct(id=_STR, volumeInfo=VOLUME_INFO, saleInfo=SALE_INFO)

# one landed API response: the items of one page of one author's results
PAGE = _struct(author=_STR, page=_INT, totalItems=_INT, items=T.ArrayType(VOLUME))

# raw table: partition columns last, both text
RAW = T.StructType(VOLUME.fields + _struct(date=_STR, hour=_STR).fields)

STAGING = _struct(
    id=_STR,
    title=_STR,
    subtitle=_STR,
    primary_author=_STR,
    all_authors=T.ArrayType(_STR),
    publisher=_STR,
    published_date=T.DateType(),
    description=_STR,
    page_count=_INT,
    primary_category=_STR,
    all_categories=T.ArrayType(_STR),
    avg_rating=_DBL,
    ratings_count=_INT,
    thumbnail_url=_STR,
    language=_STR,
    preview_link=_STR,
    sale_country=_STR,
    saleability=_STR,
    list_price=_DBL,
    currency=_STR,
    buy_link=_STR,
    publication_year=_INT,
    processing_date=_STR,
)

CLEAN_COLUMNS = [
    "id", "title", "primary_author", "description", "publisher", "published_date", "page_count",
    "primary_category", "avg_rating", "ratings_count", "thumbnail_url", "preview_link",
    "list_price", "buy_link",
]

DASHBOARD_COLUMNS = [
    "title", "primary_author", "publisher", "publication_year", "avg_rating", "ratings_count",
    "primary_category", "list_price", "currency",
]

LEDGER = _struct(
    processing_order=_INT,
    author_name=_STR,
    processed_date=T.TimestampType(),
    raw_books_count=_INT,
    deduplicated_books_count=_INT,
    books_found=_INT,
)
