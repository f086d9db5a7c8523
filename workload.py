"""The catalogue's operators run over the given tables, each whole.

``documents`` stands in for the books: its source is the author, its first sentence the
title, and the remaining fields are derived from its columns so that every branch of the
staging rules occurs.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.functions import text as text_fn
from shelf.functions.values import publication_year, published_date
from shelf.operators import books, descriptions, ledger, staging, stats, titles, vectors, volumes
from shelf.operators.places import places
from shelf.plans.dashboard import dashboard
from shelf.plans.ingest import deduplicate_books, ingest_batch
from shelf.plans.search import build_vectors, recommend, vectorize
from shelf.plans.staging import stage_dates, stage_unseen
from shelf.schemas import RAW, STAGING, VOLUME
from shelf.scratch import materialize, run_folder, spread
from shelf.session import apply_settings
from shelf.sinks import writers
from shelf.sinks.writers import overwrite_partitions
from shelf.sources import readers
from shelf.streaming.stage import append_stream, stage_stream

AS_OF_YEAR = 2010


# tables whose rows cost much more to process than to move
LONG_TEXT = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in LONG_TEXT else scan


# -- documents as raw volumes -------------------------------------------------------------

TITLE = r"^[^.\n]+"


def _published() -> F.Column:
    year = (F.lit(1900) + F.col("n_chars") % 125).cast("string")
    month = F.lpad((1 + F.col("n_chars") % 13).cast("string"), 2, "0")
    day = F.lpad((1 + F.col("n_chars") % 31).cast("string"), 2, "0")
    return (
        F.when(F.col("lang") == "en", F.concat_ws("-", year, month, day))
        .when(F.col("lang") == "fr", F.concat_ws("-", year, month))
        .when(F.col("lang") == "de", year)
        .otherwise(F.concat_ws("-", year, F.lit("5")))
    )


def volumes_of(docs: DataFrame) -> DataFrame:
    """(author, ord, id, volumeInfo, saleInfo, date, hour) of every document."""
    lang, n = F.col("lang"), F.col("n_chars")
    info = F.struct(
        F.regexp_extract("text", TITLE, 0).alias("title"),
        F.when(lang != "en", lang).alias("subtitle"),
        F.when(lang == "es", F.array("source", "lang")).otherwise(F.array("source")).alias("authors"),
        F.when(lang != "fr", F.concat(F.lit("Publishing house "), F.col("source"))).alias("publisher"),
        _published().alias("publishedDate"),
        F.col("text").alias("description"),
        F.floor(n / 1800).cast("int").alias("pageCount"),
        F.when(lang != "fr", F.array("lang", "source")).alias("categories"),
        (n % 51 / 10).cast("double").alias("averageRating"),
        (n % 7).cast("int").alias("ratingsCount"),
        F.when(lang != "de", F.struct(F.concat(F.lit("https://covers.example/"), F.col("doc_id")).alias("thumbnail")))
        .alias("imageLinks"),
        F.when(lang != "de", lang).alias("language"),
        F.concat(F.lit("https://books.example/"), F.col("doc_id")).alias("previewLink"),
    )
    sale = F.struct(
        F.when(lang != "es", F.lit("GB")).alias("country"),
        F.when(n % 2 == 0, F.lit("FOR_SALE")).alias("saleability"),
        F.when(
            n % 2 == 0,
            F.struct((n / 100).cast("double").alias("amount"), F.lit("EUR").alias("currencyCode")),
        ).alias("listPrice"),
        F.when(n % 2 == 0, F.lit("https://shop.example/")).alias("buyLink"),
    )
    return docs.select(
        F.col("source").alias("author"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("id"),
        info.alias("volumeInfo"),
        sale.alias("saleInfo"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + n % 28).cast("string"), 2, "0")).alias("date"),
        F.lpad((n % 3 * 8).cast("string"), 2, "0").alias("hour"),
    )


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes_of(table(spark, sf_dir, "documents"))


def staged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_rows(raw_docs(spark, sf_dir))


def titled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", F.regexp_extract("text", TITLE, 0).alias("title"))


def readable(df: DataFrame) -> DataFrame:
    """Dates and lists as text, so that two engines print them alike."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(field.name))
    return df.select(*out)


# -- ingest ---------------------------------------------------------------------------------


def volume_filter(spark, sf_dir):
    return volumes.volume_filter(raw_docs(spark, sf_dir)).select(
        "id", "author", F.col("volumeInfo.title").alias("title"),
        F.length("volumeInfo.description").alias("description_length"))


def volume_filter_market(spark, sf_dir):
    kept = volumes.volume_filter(raw_docs(spark, sf_dir), language="fr", country="GB")
    return kept.select("id", "author", F.col("saleInfo.country").alias("country"))


def page_stop(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return volumes.page_stop(
        turns, "conv_id", "turn", F.size(text_fn.words("text")), max_pages=5
    ).select("conv_id", "turn", "role")


def response_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as landed API pages: a turn is a page, its lines are the items."""
    turns = table(spark, sf_dir, "conversations")
    item = (
        "transform(split(text, '\\\\n'), (line, i) -> named_struct("
        "'id', concat(conv_id, '.', turn, '.', i),"
        " 'volumeInfo', named_struct('title', line, 'language', role)))"
    )
    pages = turns.select(
        F.col("conv_id").cast("string").alias("author"), F.col("turn").cast("int").alias("page"),
        F.to_json(F.struct(F.expr(item).alias("items"))).alias("body"))
    body = T.StructType([T.StructField("items", T.ArrayType(VOLUME))])
    return pages.select("author", "page", F.from_json("body", body)["items"].alias("items"))


def response_items(spark, sf_dir):
    return volumes.page_items(response_pages(spark, sf_dir)).select(
        "author", "ord", "id", F.col("volumeInfo.title").alias("title"),
        F.col("volumeInfo.language").alias("language"))


def json_fields(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("encoded"))


def land_raw(raw: DataFrame, path: str) -> None:
    """Raw rows under the date and hour they carry."""
    rows = raw.select(*RAW.fieldNames()).hint("rebalance", F.col("date"), F.col("hour"))
    rows.write.partitionBy("date", "hour").parquet(path)


def own_database(spark: SparkSession, name: str) -> str:
    """A database of this run whose tables lie in the shared folder."""
    database = f"{name}_{uuid.uuid4().hex}"
    readers.create_database(spark, database, location=own_path(spark, database))
    return database


def raw_table(spark, sf_dir):
    """The landed volumes as a partitioned table over their folder."""
    path, database = own_path(spark, "landed"), own_database(spark, "books")
    land_raw(raw_docs(spark, sf_dir), path)
    rows = readers.create_raw_table(spark, f"{database}.books_raw", path)
    return rows.select("id", "volumeInfo.title", "saleInfo.listPrice.amount", "date", "hour")


def author_lines(spark, sf_dir):
    """Customer names written as lines in key order and numbered again on reading."""
    path = own_path(spark, "authors")
    table(spark, sf_dir, "customer").orderBy("c_custkey").select(
        F.concat(F.lit(" "), "c_name", F.lit("\t"))).write.text(path)
    return readers.author_list(spark, path)


def json_round_trip(spark, sf_dir):
    path = own_path(spark, "json")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp"))
    writers.write_json(events, path)
    back = readers.json_rows(spark, path, events.schema)
    return back.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def csv_export(spark, sf_dir):
    """The dashboard's rows through a header CSV."""
    path = own_path(spark, "csv")
    rows = stats.dashboard_rows(staged_docs(spark, sf_dir))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.result_csv(spark, path, rows.schema)


def landed_partitions(spark, sf_dir):
    path = own_path(spark, "landed")
    land_raw(raw_docs(spark, sf_dir), path)
    landed = readers.raw_volumes(spark, path, "2024-01-05", "2024-01-20")
    return landed.groupBy("date", "hour").agg(
        F.count(F.lit(1)).alias("books"), F.sum(F.length("volumeInfo.description")).alias("characters"))


def own_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def title_dedup(spark, sf_dir):
    return titles.title_dedup(titled_docs(spark, sf_dir), "source", "doc_id", "title").select(
        "doc_id", "source", "title")


def title_dedup_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return titles.title_dedup(part, "p_brand", "p_partkey", "p_name").select("p_partkey", "p_brand", "p_name")


def description_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return descriptions.description_pairs(docs, "source", "doc_id", "text").select(
        "source", "first_a", "first_b", "copies_a", "copies_b", F.round("overlap", 6).alias("overlap"))


def description_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return descriptions.description_dedup(docs, "source", "doc_id", "text").select("doc_id", "source")


def deduplicated_books(spark, sf_dir):
    """Volume filter, title rule, description rule: what an ingest run lands."""
    raw = materialize(volumes.volume_filter(raw_docs(spark, sf_dir)), "raw")
    return deduplicate_books(raw).select("author", "id")


# -- ledger -----------------------------------------------------------------------------------


def ledger_upsert(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("processing_order"), F.col("c_mktsegment").alias("state"),
        F.col("c_acctbal").alias("amount"))
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("processing_order"), F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").alias("amount"), "o_orderkey")
    return ledger.upsert(current, changes, sequence="o_orderkey")


def ledger_counts(spark, sf_dir):
    authors = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("processing_order"), F.col("c_custkey").alias("author_name"))
    raw = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "processing_order")
    kept = raw.where(F.col("o_orderstatus") == "F")
    rows = ledger.ledger_rows(authors, raw, kept, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rows.drop("processed_date")


def count_mismatch(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("processing_order"))
    pending = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    ordered = pending.select(F.col("o_custkey").alias("processing_order")).distinct()
    odd = ledger.count_mismatch(customers, ordered)
    return odd.select("processing_order", F.coalesce("in_raw", F.lit(False)).alias("in_raw"),
                      F.coalesce("in_kept", F.lit(False)).alias("in_kept"))


def resume_slice(spark, sf_dir):
    authors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("processing_order"), "c_name")
    done = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("processing_order"))
    return ledger.next_batch(authors, done)


def last_processed(spark, sf_dir):
    return ledger.last_processed(table(spark, sf_dir, "orders"), "o_custkey")


def ledger_table(spark, sf_dir):
    """Two batches merged into the ledger table: customers, then suppliers over them."""
    name = f"{own_database(spark, 'ledger')}.processed_authors"
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("processed_date")
    none = [F.lit(None).cast("int").alias(c) for c in ("deduplicated_books_count", "books_found")]
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("processing_order"), F.col("c_name").alias("author_name"), stamp,
        F.col("c_nationkey").alias("raw_books_count"), *none)
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("processing_order"), F.col("s_name").alias("author_name"), stamp,
        F.lit(None).cast("int").alias("raw_books_count"), *none)
    writers.save_ledger(spark, customers, name)
    writers.save_ledger(spark, suppliers, name)
    return readers.ledger_table(spark, name).drop("processed_date")


def kept_ids(spark, sf_dir):
    return ledger.ids_by_group(table(spark, sf_dir, "documents"), "source", "doc_id")


# -- staging ----------------------------------------------------------------------------------


def flatten_nested(spark, sf_dir):
    return readable(staged_docs(spark, sf_dir))


def ragged_volumes(raw: DataFrame) -> DataFrame:
    """The volumes with something missing in every field that staging looks at, and a fifth of the rows twice."""
    n, info = F.col("ord"), F.col("volumeInfo")
    for field, gone in {
        "title": n % 23 == 1, "authors": n % 23 == 3, "publishedDate": n % 23 == 4, "description": n % 23 == 6,
        "pageCount": n % 7 == 1, "averageRating": n % 7 == 2, "ratingsCount": n % 7 == 3, "previewLink": n % 7 == 4,
    }.items():
        info = info.withField(field, F.when(~gone, F.col(f"volumeInfo.{field}")))
    info = info.withField("authors", F.when(n % 23 == 2, F.array().cast("array<string>")).otherwise(info["authors"]))
    info = info.withField("publishedDate", F.when(n % 23 == 5, "").otherwise(info["publishedDate"]))
    info = info.withField("categories", F.when(n % 7 == 5, F.array().cast("array<string>")).otherwise(info["categories"]))
    ragged = raw.withColumns({"volumeInfo": info, "id": F.when(n % 101 != 0, F.col("id"))})
    return ragged.union(ragged.where(n % 5 == 0))


def ragged_staging(spark, sf_dir):
    return readable(staging.stage_rows(ragged_volumes(raw_docs(spark, sf_dir))).select(
        "id", "primary_author", "all_authors", "page_count", "primary_category", "all_categories", "avg_rating",
        "ratings_count", "preview_link", "processing_date"))


def staged_range(spark, sf_dir):
    return readable(
        staging.stage_rows(raw_docs(spark, sf_dir), "2024-01-05", "2024-01-20")
        .select("id", "publisher", "published_date", "processing_date"))


def _spelled_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    spelled = (
        F.when(F.col("o_orderpriority").startswith("1"), day)
        .when(F.col("o_orderpriority").startswith("2"), F.substring(day, 1, 7))
        .when(F.col("o_orderpriority").startswith("3"), F.substring(day, 1, 4))
        .when(F.col("o_orderpriority").startswith("4"), F.substring(day, 1, 6))
        .otherwise(F.concat(F.substring(day, 1, 5), F.substring(day, 9, 2)))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", spelled.alias("spelled"))


def parse_dates(spark, sf_dir):
    return _spelled_dates(spark, sf_dir).select(
        "o_orderkey", "spelled", published_date("spelled").cast("string").alias("published_date"))


def year_of_date(spark, sf_dir):
    return _spelled_dates(spark, sf_dir).select(
        "o_orderkey", publication_year("spelled").alias("publication_year"))


def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").distinct()


def _dated_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"))


def incremental_new(spark, sf_dir):
    events = _dated_events(table(spark, sf_dir, "events"))
    target = raw_docs(spark, sf_dir).select(F.col("date").alias("processing_date"))
    return staging.newer_than(events, target)


def incremental_reprocess(spark, sf_dir):
    events = _dated_events(table(spark, sf_dir, "events"))
    target = raw_docs(spark, sf_dir).select(F.col("date").alias("processing_date"))
    return staging.newer_than(events, target, on_late="reprocess")


def latest_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return staging.latest_by_id(events, "user_id", "event_id")


def partition_overwrite(spark, sf_dir):
    """Stage every date, stage a range again from other rows, read a range back."""
    path = own_path(spark, "staged")
    events = _dated_events(table(spark, sf_dir, "events")).withColumnRenamed("date", "processing_date")
    overwrite_partitions(events, path)
    again = events.where(
        F.col("processing_date").between("2024-01-10", "2024-01-12") & (F.col("event_type") == "view"))
    overwrite_partitions(again, path)
    return readers.staged_files(spark, path, "2024-01-08", "2024-01-15", events.schema)


def staged_by_stream(spark, sf_dir):
    """The same events staged by a stream that reads the landed file."""
    events = table(spark, sf_dir, "events")
    path, marks = own_path(spark, "streamed"), own_path(spark, "stream-marks")

    def rows(raw: DataFrame) -> DataFrame:
        return raw.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("processing_date")).distinct()

    stage_stream(spark, sf_dir, path, marks, schema=events.schema, date=F.date_format("ts", "yyyy-MM-dd"), rows=rows,
                 pathGlobFilter="events.parquet")
    return spark.read.schema("user_id long, event_type string, processing_date string").parquet(path)


def append_frames(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("text"))
    return readers.append_frames([docs, pages]).select("id", "lang", "url", F.length("text").alias("characters"))


# -- cleaning -----------------------------------------------------------------------------------


def null_sentinels(spark, sf_dir):
    rows = staged_docs(spark, sf_dir).select(
        "id", "publisher", "page_count", "avg_rating", "ratings_count", "thumbnail_url", "list_price", "buy_link",
        "subtitle")
    return books.null_sentinels(rows)


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_fn.clean_text("text").alias("cleaned"))


def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text_fn.clean_text("html").alias("cleaned"), text_fn.clean_text("url").alias("cleaned_url"))


def clean_books(spark, sf_dir):
    return readable(books.with_text(books.clean_books(staged_docs(spark, sf_dir))))


def text_measures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = text_fn.words("text")
    return docs.select(
        "doc_id",
        F.length(text_fn.strip("text")).alias("bare_length"),
        F.size(words).alias("n_words"),
        F.length(F.array_join(words, " ")).alias("spaced_length"),
        text_fn.normal_title(F.regexp_extract("text", TITLE, 0)).alias("title"),
        text_fn.preview("text").alias("preview"),
    )


def text_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return readers.file_counts(books.with_text(docs, "text")).agg(
        F.sum("rows").alias("texts"), F.count(F.lit(1)).alias("files"))


def truncate_labels(spark, sf_dir):
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text_fn.shorten(label).alias("label"))


# -- dashboard ------------------------------------------------------------------------------------


def summary_cards(spark, sf_dir):
    cards = stats.summary_cards(stats.dashboard_rows(staged_docs(spark, sf_dir)), AS_OF_YEAR)
    return cards.withColumn("avg_rating", F.round("avg_rating", 6))


def _sold(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("publication_year"),
        (F.col("l_discount") * 50).alias("avg_rating"),
        F.col("l_linenumber").alias("ratings_count"))


def summary_cards_large(spark, sf_dir):
    return stats.summary_cards(_sold(spark, sf_dir), AS_OF_YEAR).withColumn("avg_rating", F.round("avg_rating", 6))


def top_publishers(spark, sf_dir):
    return stats.top_labels(stats.dashboard_rows(staged_docs(spark, sf_dir)), "publisher")


def top_labels(spark, sf_dir):
    return stats.top_labels(table(spark, sf_dir, "part"), "p_brand")


def category_share(spark, sf_dir):
    return stats.share_filter(stats.dashboard_rows(staged_docs(spark, sf_dir)), "primary_category")


def share_filter(spark, sf_dir):
    return stats.share_filter(table(spark, sf_dir, "part"), F.col("p_size").cast("string"))


def share_with_other(spark, sf_dir):
    return stats.share_filter(table(spark, sf_dir, "part"), F.col("p_size").cast("string"), keep_other=True)


def per_year(spark, sf_dir):
    return stats.per_year(_sold(spark, sf_dir))


def books_per_year(spark, sf_dir):
    return stats.per_year(stats.dashboard_rows(staged_docs(spark, sf_dir)))


def rating_histogram(spark, sf_dir):
    return stats.rating_histogram(_sold(spark, sf_dir))


def newest_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return stats.newest_rows(orders, year="year", ties=("o_orderpriority", "o_orderkey")).select(
        "o_orderkey", "o_orderpriority", "year")


def highlight(spark, sf_dir):
    return stats.highlight(staged_docs(spark, sf_dir).select("id", "title", "avg_rating"))


# -- vectors and search -----------------------------------------------------------------------------


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of the label's vectors."""
    wide = array_to_vector(F.col("embedding").cast("array<double>"))
    means = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("qid")).agg(Summarizer.mean(wide).alias("mean"))
    return means.select("qid", vector_to_array("mean").alias("vector"))


def _knn(spark, sf_dir, metric):
    found = vectors.nearest(
        table(spark, sf_dir, "embeddings"), label_centres(spark, sf_dir), metric=metric, id="vec_id", vector="embedding")
    return found.select("qid", "rank", "id", F.round("distance", 6).alias("distance"))


def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "l2")


def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


def knn_dot(spark, sf_dir):
    return _knn(spark, sf_dir, "dot")


def result_cards(spark, sf_dir):
    """Cards of the staged books that sit nearest to each label's centre."""
    found = knn_l2(spark, sf_dir).withColumn("id", F.col("id").cast("string")).drop("distance")
    return readable(vectors.result_cards(found, staged_docs(spark, sf_dir)))


def embed_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cells = vectors.embed(docs, "text").select("doc_id", F.posexplode_outer("vector").alias("cell", "weight"))
    return cells.where(F.col("weight") != 0).select(
        "doc_id", "cell", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def search_texts(spark, sf_dir):
    """Every benchmark text as a question to the documents."""
    docs = vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    asked = table(spark, sf_dir, "benchmark")
    found = vectors.search(docs, asked, metric="cosine", text="text", qid="item_id", id="doc_id")
    return found.select("qid", "rank", "id", F.round("distance", 4).alias("distance"))


def vector_rows(spark, sf_dir):
    """The vector table's rows from staged books, with the number of cells that the vector fills."""
    return readable(vectorize(staged_docs(spark, sf_dir)).select(
        "id", "title", "published_date", F.length("processed_text").alias("characters"),
        F.size("vector").alias("dims"), F.size(F.filter("vector", lambda x: x != 0)).alias("cells")))


def vector_table(spark, sf_dir):
    """The given vectors written twice, then a third time without ids already there."""
    name = f"{own_database(spark, 'vectors')}.vectors"
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for mode in ("append", "append", "append_new"):
        writers.write_vectors(rows, name, mode)
    return readers.vector_table(spark, name).groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dims"))


# -- whole jobs ----------------------------------------------------------------------------------------


def staging_job(spark, sf_dir):
    """Landed volumes staged in three runs: half a month, what came after, and the last day again."""
    landed, target = own_path(spark, "landed"), own_path(spark, "staged")
    land_raw(raw_docs(spark, sf_dir), landed)
    raw = readers.raw_volumes(spark, landed)
    stage_dates(spark, raw, target, "2024-01-01", "2024-01-15")
    stage_dates(spark, raw, target, "2024-01-01", "2024-01-28")
    stage_dates(spark, raw, target, "2024-01-01", "2024-01-28", on_late="reprocess")
    staged = readers.staged_files(spark, target, "2024-01-01", "2024-01-31")
    return readable(staged.select("id", "title", "publisher", "published_date", "list_price", "processing_date"))


def landed_pages(volumes_: DataFrame, path: str) -> None:
    """Each author's volumes as response files, forty items a page."""
    numbered = places(volumes_.select("author", "ord", "id", "volumeInfo", "saleInfo"), "author", "ord")
    page = F.floor(F.col("place") / volumes.PAGE_SIZE).cast("int")
    item = F.struct("ord", F.struct("id", "volumeInfo", "saleInfo").alias("item"))
    pages = numbered.groupBy("author", page.alias("page")).agg(F.array_sort(F.collect_list(item)).alias("sorted"))
    writers.write_json(pages.select("author", "page", F.col("sorted.item").alias("items")), path)


def ingest_job(spark, sf_dir):
    """Response files and an author list to landed books, their ids and the ledger, in two batches."""
    docs = table(spark, sf_dir, "documents")
    responses, listed, books, ids = (own_path(spark, n) for n in ("responses", "authors", "books", "ids"))
    landed_pages(volumes_of(docs), responses)
    names = docs.select("source").distinct()
    names.orderBy("source").write.text(listed)
    name = f"{own_database(spark, 'ledger')}.processed_authors"
    size = -(-names.count() // 2)
    pages = 1 + readers.responses(spark, responses).agg(F.max("page")).first()[0]  # all of every author
    for _ in range(2):
        ingest_batch(spark, readers.author_list(spark, listed), readers.responses(spark, responses), books, ids,
                     name, size, pages, at=datetime(2024, 3, 5, 7, 8, 9))
    landed = spark.read.parquet(books).where("date = '2024-03-05' and hour = 7").select("id", "volumeInfo.authors")
    counted = landed.join(spark.read.parquet(ids).select("id"), "id").groupBy(F.col("authors")[0].alias("author_name"))
    return (
        readers.ledger_table(spark, name)
        .join(counted.agg(F.count(F.lit(1)).alias("landed")), "author_name", "left")
        .select("processing_order", "author_name", F.date_format("processed_date", "yyyy-MM-dd HH:mm:ss").alias("processed_date"),
                "raw_books_count", "deduplicated_books_count", "books_found", F.coalesce("landed", F.lit(0)).alias("landed"))
    )


def vector_job(spark, sf_dir):
    """How many vectors each run writes: two ranges of dates, one without files, one without a description."""
    path, database = own_path(spark, "staged"), own_database(spark, "vectors")
    writers.overwrite_partitions(staged_docs(spark, sf_dir), path)
    runs = [("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-28"), ("2025-01-01", "2025-12-31")]
    written = [(f"{a} to {b}", build_vectors(spark, path, a, b, f"{database}.books")) for a, b in runs]
    bare = vectorize(readers.staged_files(spark, path, *runs[0]).drop("description"))
    written.append(("no description", writers.write_vectors(bare, f"{database}.bare")))
    steps = spark.createDataFrame(written, "step string, rows long")
    stored = readers.vector_table(spark, f"{database}.books").agg(F.lit("stored").alias("step"), F.count(F.lit(1)).alias("rows"))
    return steps.union(stored)


def recommend_job(spark, sf_dir):
    """Cards of the books nearest to every benchmark text."""
    books = materialize(vectorize(staged_docs(spark, sf_dir)), "vectors")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return recommend(books, asked).select("qid", "rank", "id", "title", F.length("preview").alias("preview_length"))


def dashboard_job(spark, sf_dir):
    """Every panel of the dashboard as (panel, label, value)."""
    panels = dashboard(staged_docs(spark, sf_dir), AS_OF_YEAR)
    shown = {
        "summary": (F.lit("books"), F.col("total_books")),
        "per_year": (F.col("publication_year"), F.col("count")),
        "publishers": (F.col("label"), F.col("count")),
        "categories": (F.col("label"), F.col("count")),
        "ratings": (F.col("bin"), F.col("count")),
        "newest": (F.col("title"), F.col("publication_year")),
    }
    rows = [
        panels[name].select(F.lit(name).alias("panel"), label.cast("string").alias("label"), value.cast("long").alias("value"))
        for name, (label, value) in shown.items()
    ]
    return reduce(DataFrame.union, rows)


def differing_files(spark, sf_dir):
    """Files with different columns read as one frame."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    one, two = own_path(spark, "one"), own_path(spark, "two")
    docs.select(F.col("doc_id").alias("id"), "lang", "n_chars").write.parquet(one)
    pages.select(F.col("page_id").alias("id"), "url").write.parquet(two)
    return readers.many_files(spark, [one, two]).select("id", "lang", "n_chars", "url")


def clashing_files(spark, sf_dir):
    """A column that files spell as a whole number, a longer one, a fraction and a text; and one that only widens."""
    part = table(spark, sf_dir, "part")
    spellings = {
        "int": (F.col("p_size").cast("int"), F.col("p_size").cast("int")),
        "long": (F.col("p_partkey") * 1_000_000_007, F.col("p_partkey")),
        "double": (F.col("p_retailprice"), F.col("p_retailprice")),
        "string": (F.col("p_brand"), F.col("p_size").cast("long")),
    }
    paths = []
    for k, (label, amount) in enumerate(spellings.values()):
        paths.append(own_path(spark, "spelled"))
        rows = part.where(F.col("p_partkey") % 4 == k)
        rows.select("p_partkey", label.alias("label"), amount.alias("amount")).write.parquet(paths[-1])
    return readers.many_files(spark, paths)


def files_by_path(spark, sf_dir):
    """Files of five layouts found by the date in their paths: rows by date, in the range only."""
    root, events = own_path(spark, "mixed"), _dated_events(table(spark, sf_dir, "events"))
    layouts = {
        "2024-01-05": "processing_date=2024-01-05", "2024-01-06": "archive/2024/2024-01-06/rows", "2024-01-07": "export-2024-01-07",
        "2024-01-08": "2023-12-31/processing_date=2024-01-08", "2024-01-20": "processing_date=2024-01-20",
    }
    for date, place in layouts.items():
        events.where(F.col("date") == date).drop("date").coalesce(1).write.parquet(f"{root}/{place}")
    none = events.where("false").drop("date").coalesce(1)
    none.write.parquet(f"{root}/processing_date=2024-01-09")  # a file without rows
    none.write.parquet(f"{root}/undated")
    files = readers.dated_files(spark, root).where(F.col("date").between("2024-01-05", "2024-01-19"))
    files = files.groupBy("date").agg(F.count(F.lit(1)).alias("files"))
    rows = readers.files_in_range(spark, root, "2024-01-05", "2024-01-19").groupBy("file_date")
    rows = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("user_id").alias("users"))
    return files.join(rows, F.col("date") == F.col("file_date"), "left").select(
        "date", "files", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("users", F.lit(0)).alias("users"))


def late_files_job(spark, sf_dir):
    """Landed volumes staged by their files: most of them, then files that arrive late for dates long staged."""
    landed, target, manifest = own_path(spark, "landed"), own_path(spark, "staged"), own_path(spark, "manifest")
    raw = raw_docs(spark, sf_dir)
    late = F.col("ord") % 10 == 3
    land_raw(raw.where(~late), landed)
    stage_unseen(spark, landed, target, manifest)
    arrived = raw.where(late & (F.col("date") < "2024-01-15")).withColumn("hour", F.lit("23"))
    arrived.select(*RAW.fieldNames()).write.partitionBy("date", "hour").mode("append").parquet(landed)
    stage_unseen(spark, landed, target, manifest)
    staged = readers.staged_files(spark, target, "2024-01-01", "2024-01-31")
    return readable(staged.select("id", "title", "publisher", "published_date", "list_price", "processing_date"))


def late_hours_by_stream(spark, sf_dir):
    """The same two landings staged by a stream that remembers rows, in several micro-batches; some rows land twice."""
    landed, target, marks = (own_path(spark, n) for n in ("landed", "streamed", "stream-marks"))
    raw = raw_docs(spark, sf_dir)
    late = F.col("ord") % 10 == 3
    land_raw(raw.where(~late), landed)
    append_stream(spark, landed, target, marks, files_per_batch=20)
    again = raw.where((late | (F.col("ord") % 10 == 4)) & (F.col("date") < "2024-01-15")).withColumn("hour", F.lit("23"))
    again.select(*RAW.fieldNames()).write.partitionBy("date", "hour").mode("append").parquet(landed)
    append_stream(spark, landed, target, marks, files_per_batch=20)
    staged = spark.read.schema(STAGING).parquet(target)
    return readable(staged.select("id", "title", "publisher", "published_date", "list_price", "processing_date"))


def staging_limit(spark, sf_dir):
    """How many rows a trial run with a limit stages."""
    return staging.stage_rows(raw_docs(spark, sf_dir), limit=150).agg(F.count(F.lit(1)).alias("rows"))


# -- flagship -----------------------------------------------------------------------------------------


def catalogue_report(spark, sf_dir):
    """English documents, cleaned, one per title, counted per source: the top eight."""
    docs = titled_docs(spark, sf_dir).where((F.col("lang") == "en") & (F.length("text") > 100))
    kept = titles.title_dedup(docs, "source", "doc_id", "title").withColumn("cleaned", text_fn.clean_text("text"))
    return (
        kept.groupBy("source")
        .agg(F.count(F.lit(1)).alias("books"), F.round(F.avg(F.length("cleaned")), 3).alias("mean_length"))
        .orderBy(F.desc("books"), "source")
        .limit(8)
    )


QUERIES = [
    volume_filter, volume_filter_market, page_stop, response_items, json_fields, landed_partitions,
    raw_table, author_lines, json_round_trip, csv_export,
    title_dedup, title_dedup_parts, description_pairs, description_dedup, deduplicated_books,
    ledger_upsert, ledger_counts, count_mismatch, resume_slice, last_processed, ledger_table, kept_ids,
    flatten_nested, ragged_staging, staged_range, parse_dates, year_of_date, distinct_rows, incremental_new,
    incremental_reprocess, latest_rows, partition_overwrite, staged_by_stream, append_frames,
    null_sentinels, clean_text, clean_pages, clean_books, text_measures, text_counts, truncate_labels,
    summary_cards, summary_cards_large, top_publishers, top_labels, category_share, share_filter,
    share_with_other, per_year, books_per_year, rating_histogram, newest_rows, highlight,
    knn_l2, knn_cosine, knn_dot, result_cards, embed_rows, search_texts, vector_rows, vector_table,
    staging_job, ingest_job, vector_job, recommend_job, dashboard_job, differing_files,
    clashing_files, files_by_path, late_files_job, late_hours_by_stream, staging_limit,
    catalogue_report,
]


def runnable(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(apply_settings(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    return {q.__name__: runnable(q) for q in QUERIES}
