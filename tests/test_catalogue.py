import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import plan_of
from shelf.operators import books, staging, stats, volumes
from shelf.plans.dashboard import dashboard
from shelf.schemas import PAGE, RAW, STAGING


def volume(id="v", title="T", authors=("A",), description="d" * 101, date="2024-01-01", hour="07", sale=None, **info):
    info = {"title": title, "authors": None if authors is None else list(authors), "description": description,
            "publishedDate": "2020", "language": "en", **info}
    return {"id": id, "volumeInfo": info, "saleInfo": sale, "date": date, "hour": hour}


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_staging_filter(spark):
    rows = [
        volume("ok"),
        volume("short", description="d" * 100),
        volume(None),
        volume("untitled", title=None),
        volume("nobody", authors=()),
        volume("unknown authors", authors=None),
        volume("undated", publishedDate=None),
        volume("empty date", publishedDate=""),
        volume("early", date="2023-12-31"),
        volume("late", date="2024-02-01"),
    ]
    kept = staging.stageable(raw(spark, *rows), "2024-01-01", "2024-01-31")
    assert [r.id for r in kept.collect()] == ["ok"]


def test_flatten_fills_what_is_missing(spark):
    sale = {"country": "GB", "saleability": "FOR_SALE", "listPrice": {"amount": 2.5, "currencyCode": "EUR"}, "buyLink": "b"}
    full = volume("full", sale=sale, categories=["Fiction", "Sea"], pageCount=9, averageRating=4.5, ratingsCount=3,
                  imageLinks={"thumbnail": "t"}, publisher="P", subtitle="S", previewLink="p", publishedDate="2020-05")
    out = {r.id: r for r in staging.flatten(raw(spark, full, volume("bare", language=None))).collect()}
    assert out["full"] == Row(
        id="full", title="T", subtitle="S", primary_author="A", all_authors=["A"], publisher="P",
        published_date=datetime.date(2020, 5, 1), description="d" * 101, page_count=9, primary_category="Fiction",
        all_categories=["Fiction", "Sea"], avg_rating=4.5, ratings_count=3, thumbnail_url="t", language="en",
        preview_link="p", sale_country="GB", saleability="FOR_SALE", list_price=2.5, currency="EUR", buy_link="b",
        publication_year=2020, processing_date="2024-01-01")
    bare = out["bare"].asDict()
    assert {k: bare[k] for k in staging.DEFAULTS} == {**staging.DEFAULTS, "description": "d" * 101}
    assert bare["primary_category"] == "Uncategorized" and bare["all_categories"] is None
    assert staging.flatten(raw(spark, full)).schema.fieldNames() == STAGING.fieldNames()


def test_repeated_rows_collapse_within_a_date_only(spark):
    rows = raw(spark, volume(), volume(), volume(hour="08"), volume(date="2024-01-02"))
    assert staging.stage_rows(rows).count() == 2
    assert staging.stage_rows(rows, limit=1).count() == 1
    newest = staging.latest_by_id(staging.stage_rows(rows)).collect()
    assert [r.processing_date for r in newest] == ["2024-01-02"]


@pytest.mark.parametrize("on_late, want", [("drop", ["c"]), ("reprocess", ["b", "c"])])
def test_newer_than(spark, on_late, want):
    rows = raw(spark, volume("a", date="2024-01-01"), volume("b", date="2024-01-02"), volume("c", date="2024-01-03"))
    have = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "processing_date string")
    assert sorted(r.id for r in staging.newer_than(rows, have, on_late=on_late).collect()) == want
    empty = staging.newer_than(rows, have.where("false"), on_late=on_late).count()
    assert empty == (0 if on_late == "drop" else 3)
    assert staging.newer_than(rows, None).count() == 3


def page(author, number, n, **item):
    return {"author": author, "page": number, "totalItems": None,
            "items": None if n is None else [{"id": f"{author}{number}.{k}", "volumeInfo": volume(**item)["volumeInfo"],
                                              "saleInfo": None} for k in range(n)]}


def test_pages_stop_at_the_first_short_one(spark):
    pages = [page("a", k, n) for k, n in enumerate((40, 40, 39, 40))]
    pages += [page("b", k, 40) for k in range(11)] + [page("c", 0, None), page("c", 1, 40)]
    df = spark.createDataFrame(pages, PAGE)
    kept = volumes.page_stop(df, max_pages=volumes.INGEST_PAGES)
    assert sorted((r.author, r.page) for r in kept.collect()) == (
        [("a", 0), ("a", 1), ("a", 2)] + [("b", k) for k in range(10)] + [("c", 0)])
    assert volumes.page_stop(df).where("author = 'b'").count() == 3
    items = volumes.page_items(kept)
    assert items.where("author = 'c'").count() == 0
    assert items.where("author = 'a'").agg(F.max("ord")).first()[0] == 2 * 40 + 38


def test_volume_filter(spark):
    rows = [
        ("ok", {}), ("two authors", {"authors": ("A", "B")}), ("other author", {"authors": ("B",)}),
        ("no authors", {"authors": None}), ("french", {"language": "fr"}), ("no language", {"language": None}),
        ("blank title", {"title": ""}), ("no title", {"title": None}), ("short", {"description": "d" * 100}),
        ("no description", {"description": None}), ("", {}), (None, {}),
    ]
    df = raw(spark, *[volume(id, **kw) for id, kw in rows]).withColumn("author", F.lit("A"))
    assert [r.id for r in volumes.volume_filter(df).collect()] == ["ok"]
    assert volumes.volume_filter(df, language="fr").collect()[0].id == "french"
    assert volumes.volume_filter(df, country="US").count() == 0


def staged(spark, *rows):
    return staging.flatten(raw(spark, *rows))


def test_sentinels_become_null(spark):
    rows = [volume("rated", ratingsCount=3, averageRating=0.0, title=""), volume("unrated", averageRating=3.0),
            volume("priced", publisher="P", sale={"listPrice": {"amount": 1.5}}, pageCount=4)]
    out = {r.id: r for r in books.clean_books(staged(spark, *rows)).collect()}
    assert out["rated"].avg_rating == 0.0 and out["rated"].title == ""
    assert out["unrated"].avg_rating is None and out["unrated"].ratings_count == 0
    assert out["rated"].page_count is None and out["rated"].list_price is None and out["rated"].thumbnail_url is None
    assert (out["priced"].page_count, out["priced"].list_price, out["priced"].publisher) == (4, 1.5, "P")


def test_text_is_required(spark):
    df = spark.createDataFrame([("a", " x "), ("b", " "), ("c", None)], "id string, description string")
    assert [tuple(r) for r in books.with_text(df).select("id", "processed_text").collect()] == [("a", " x ")]
    assert books.with_text(df.drop("description")).count() == 0


def stats_books(spark):
    rows = [
        ("a", "A", "Publisher of twenty c", 2001, 4.5, 2, "Fiction", 1.0, "EUR"),
        ("b", "A", "Publisher of twenty characters", 2002, 0.0, 0, "FICTION", 1.0, "EUR"),
        ("c", "A", "x" * 20, None, 5.0, 1, "History", 1.0, "EUR"),
        ("d", "A", "x" * 20, 2300, 4.0, 7, "Travel", 1.0, "EUR"),
    ]
    schema = ("title string, primary_author string, publisher string, publication_year int, avg_rating double,"
              " ratings_count int, primary_category string, list_price double, currency string")
    return spark.createDataFrame(rows, schema)


def test_dashboard(spark):
    out = dashboard(stats_books(spark), 2025)
    card = out["summary"].first()
    assert (card.total_books, card.ratings_count, card.avg_rating, card.latest_year) == (4, 10, 3.375, 2025)
    assert (card.total_books_text, card.avg_rating_text) == ("4", "3.4")
    assert [tuple(r) for r in out["per_year"].collect()] == [(2001, 1), (2002, 1), (2300, 1)]
    assert [tuple(r) for r in out["publishers"].collect()] == [("Publisher of twenty ...", 2), ("x" * 20, 2)]
    assert [(r.bin, r["count"]) for r in out["ratings"].collect()] == [(0, 1), (8, 1), (9, 2)]
    assert [r.title for r in out["newest"].collect()] == ["d", "b", "a", "c"]
    assert [r.highlight for r in out["newest"].collect()] == [False, False, True, True]


def test_share_keeps_exactly_two_percent(spark):
    labels = ["big"] * 95 + ["two"] * 2 + ["one", "uno", "ein"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert {tuple(r) for r in stats.share_filter(df, "label").collect()} == {("big", 95), ("two", 2)}
    assert {tuple(r) for r in stats.share_filter(df, "label", keep_other=True).collect()} == {
        ("big", 95), ("two", 2), ("Other", 3)}


def test_plans_stay_in_the_jvm(spark, sf_dir):
    import workload

    for name in ("flatten_nested", "clean_books", "volume_filter", "share_filter", "rating_histogram", "ledger_upsert"):
        text = plan_of(workload.queries()[name](spark, sf_dir))
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_only_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw(spark, volume(), volume(date="2024-01-02")).write.partitionBy("date", "hour").parquet(path)
    from shelf.sources.readers import raw_volumes

    rows = raw_volumes(spark, path, "2024-01-02", "2024-01-02").select("volumeInfo.title")
    text = plan_of(rows)
    assert "PartitionFilters: [isnotnull(date" in text
    assert "ReadSchema: struct<volumeInfo:struct<title:string>>" in text
    assert rows.count() == 1
