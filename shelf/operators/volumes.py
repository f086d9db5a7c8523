"""From landed API pages to one row per qualifying volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the ingest
PAGE_SIZE = 40
DEFAULT_PAGES = 3
INGEST_PAGES = 10
MIN_DESCRIPTION = 100


def page_stop(
    pages: DataFrame,
    group: str = "author",
    page: str = "page",
    n_items: Column | None = None,
    max_pages: int = DEFAULT_PAGES,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Keep an author's pages up to ``max_pages`` and up to the first short one.

    The first short page is itself kept. ``n_items`` counts raw items, before any filter.
    The stop is a ``min`` per author, which combines before the shuffle, so an author
    with very many pages does not become one sorted window.
    """
    n_items = F.coalesce(F.size("items") if n_items is None else n_items, F.lit(0))
    budget = pages.where(F.col(page) < max_pages)
    stop = (
        budget.where(n_items < page_size)
        .groupBy(F.col(group).alias("_g"))
        .agg(F.min(page).alias("_stop"))
    )
    return (
        budget.join(stop, F.col(group).eqNullSafe(F.col("_g")), "left")
        .where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop")))
        .drop("_g", "_stop")
    )


def page_items(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per item; ``ord`` is its place in the author's result list.

    A page whose item array is missing gives no rows. Offsets advance by ``page_size``
    per page, so ``ord`` is unique within an author. Other page columns are kept.
    """
    own = [c for c in pages.columns if c not in ("items", "totalItems")]
    return pages.select(*own, F.posexplode("items").alias("pos", "item")).select(
        *own,
        (F.col("page").cast("long") * page_size + F.col("pos")).alias("ord"),
        "item.id",
        "item.volumeInfo",
        "item.saleInfo",
    )


def qualifies(author: Column, language: str = "en", min_description: int = MIN_DESCRIPTION) -> Column:
    """True for a volume by exactly this author, in the language, titled and described."""
    info = F.col("volumeInfo")

    def text(name: str) -> Column:
        return F.coalesce(info[name], F.lit(""))

    return (
        info["authors"].eqNullSafe(F.array(author))
        & (text("language") == language)
        & (text("title") != "")
        & (F.length(text("description")) > min_description)
        & (F.coalesce(F.col("id"), F.lit("")) != "")
    )


def volume_filter(
    volumes: DataFrame,
    author: Column | str = "author",
    language: str = "en",
    country: str | None = None,
    min_description: int = MIN_DESCRIPTION,
) -> DataFrame:
    """Keep qualifying volumes. ``country`` adds the market the request would ask for."""
    author = F.col(author) if isinstance(author, str) else author
    keep = qualifies(author, language, min_description)
    if country is not None:
        keep = keep & (F.col("saleInfo.country") == country)
    return volumes.where(keep)


def author_volumes(
    pages: DataFrame, max_pages: int = INGEST_PAGES, page_size: int = PAGE_SIZE,
    group: str = "author", **filters
) -> DataFrame:
    """Pages to qualifying volumes, in one plan."""
    kept = page_stop(pages, group, max_pages=max_pages, page_size=page_size)
    return volume_filter(page_items(kept, page_size), **filters)
