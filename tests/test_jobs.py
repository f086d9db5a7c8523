import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from models import descriptions_left, titles_left
from shelf.operators import ledger
from shelf.operators.places import places
from shelf.plans.ingest import ingest_batch
from shelf.plans.search import build_vectors
from shelf.plans.staging import high_water_mark, stage_dates, stage_unseen
from shelf.schemas import LEDGER, RAW, STAGING
from shelf.scratch import materialize, temporary
from shelf.sinks import writers
from shelf.sources import readers
from shelf.operators.staging import stage_rows
from shelf.streaming.stage import LateRows, append_stream, stage_stream
from test_catalogue import volume

AT = datetime.datetime(2024, 3, 5, 7, 9)


@pytest.fixture
def base(spark, tmp_path):
    spark.sql("DROP DATABASE IF EXISTS shelf_jobs CASCADE")
    spark.sql(f"CREATE DATABASE shelf_jobs LOCATION '{tmp_path}/warehouse'")
    spark.catalog.setCurrentDatabase("shelf_jobs")
    yield str(tmp_path)
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE IF EXISTS shelf_jobs CASCADE")


def land(spark, path, *rows):
    spark.createDataFrame(list(rows), RAW).write.partitionBy("date", "hour").mode("append").parquet(path)


def test_author_list_keeps_lines_in_order(spark, tmp_path):
    path = tmp_path / "authors.txt"
    names = [f"  Author {k} " for k in range(12)]
    names[4] = ""
    path.write_text("\n".join(names) + "\n", encoding="utf-8")
    got = readers.author_list(spark, str(path)).orderBy("processing_order").collect()
    assert [(r.processing_order, r.author_name) for r in got] == [(k, n.strip()) for k, n in enumerate(names)]


def test_responses(spark, tmp_path):
    body = {"author": "A", "page": 0, "totalItems": 3, "items": [
        {"id": "1", "volumeInfo": {"title": "T", "mainCategory": "dropped"}, "saleInfo": {"listPrice": {"amount": 1.5}}}]}
    (tmp_path / "one.json").write_text(json.dumps(body, indent=1))
    row = readers.responses(spark, str(tmp_path / "one.json"), multiline=True).first()
    assert row["items"][0].volumeInfo.title == "T" and row["items"][0].saleInfo.listPrice.amount == 1.5


def test_ledger_merge(spark):
    rows = [(0, "a", 1), (1, "b", 1)]
    schema = "processing_order int, author_name string, raw_books_count int"
    current = spark.createDataFrame(rows, schema)
    changes = spark.createDataFrame([(1, "b", None, 1), (1, "B", 9, 2), (2, "c", 3, 3)], schema + ", seq int")
    got = sorted(tuple(r) for r in ledger.upsert(current, changes, sequence="seq").collect())
    assert got == [(0, "a", 1), (1, "B", 9), (2, "c", 3)]


@pytest.mark.parametrize("keys, options, want", [
    ([], {}, [0, 1, 2, 3, 4]),
    ([0], {}, [1, 2, 3, 4, 5]),
    ([0], {"zero_is_none": True}, [0, 1, 2, 3, 4]),
    ([0, 9], {}, [10, 11]),
    ([0, 9], {"reset_from_start": True}, [0, 1, 2, 3, 4]),
])
def test_next_batch(spark, keys, options, want):
    authors = spark.range(12).select(F.col("id").alias("processing_order"), F.lit("x").alias("author_name"))
    done = spark.createDataFrame([(k,) for k in keys], "processing_order int")
    got = ledger.next_batch(authors, done, **options)
    assert sorted(r.processing_order for r in got.collect()) == want


def test_counts_must_belong_together(spark):
    a, b = spark.range(3).toDF("processing_order"), spark.range(2).toDF("processing_order")
    ledger.check_counts(a, a)
    with pytest.raises(ValueError):
        ledger.check_counts(a, b)


def page_rows(author, books):
    items = [{"id": f"{author}-{k}", "volumeInfo": volume(title=t, authors=(author,), description=d)["volumeInfo"],
              "saleInfo": None} for k, (t, d) in enumerate(books)]
    return {"author": author, "page": 0, "totalItems": len(items), "items": items}


def test_ingest(spark, base):
    from shelf.schemas import PAGE

    def text(seed):
        return " ".join(f"word{seed}x{k}" for k in range(30))

    books = {
        "Ann": [("Tide", text(1)), ("Tide rising", text(2)), ("Salt", text(3)), ("Fog", text(3)), ("Rain", text(4))],
        "Bob": [("Emma", text(5)), ("Emma", text(6))],
    }
    pages = spark.createDataFrame([page_rows(a, b) for a, b in books.items()], PAGE)
    names = ["Ann", "Bob", "Cy", "Bob"]
    authors = spark.createDataFrame(list(enumerate(names)), "processing_order int, author_name string")
    rows = ingest_batch(spark, authors, pages, f"{base}/books", f"{base}/ids", batch_size=3, at=AT)

    want = {}
    for author, listed in books.items():
        by_title = titles_left([t for t, _ in listed])
        left = descriptions_left([listed[k][1] for k in by_title])
        want[author] = {f"{author}-{by_title[k]}" for k in left}
    landed = readers.raw_volumes(spark, f"{base}/books")
    assert {r.id for r in landed.collect()} == want["Ann"] | want["Bob"]
    assert {(r.date, r.hour) for r in landed.collect()} == {("2024-03-05", "07")}
    assert spark.read.parquet(f"{base}/ids").count() == landed.count()
    got = {r.author_name: (r.raw_books_count, r.deduplicated_books_count, r.books_found) for r in rows.collect()}
    assert got == {"Ann": (5, len(want["Ann"]), 1), "Bob": (2, len(want["Bob"]), 1), "Cy": (0, 0, 0)}
    stored = readers.ledger_table(spark)
    assert stored.schema.fieldNames() == LEDGER.fieldNames() and stored.count() == 3
    assert ledger.last_processed(stored).first()[0] == 2

    ingest_batch(spark, authors, pages, f"{base}/books", f"{base}/ids", batch_size=3, at=AT)
    assert sorted(r.processing_order for r in readers.ledger_table(spark).collect()) == [0, 1, 2, 3]
    again = [r.id for r in readers.raw_volumes(spark, f"{base}/books").collect()]
    assert sorted(again) == sorted([*want["Ann"], *want["Bob"], *want["Bob"]])


def test_raw_table_and_repair(spark, base):
    path = f"{base}/raw"
    land(spark, path, volume("a"))
    readers.create_database(spark, "shelf_jobs")
    table = readers.create_raw_table(spark, "books_raw", path)
    assert [(r.id, r.date, r.hour) for r in table.collect()] == [("a", "2024-01-01", "07")]
    land(spark, path, volume("b", date="2024-01-02"))
    readers.repair_partitions(spark, "books_raw")
    spark.catalog.refreshTable("books_raw")
    assert spark.table("books_raw").count() == 2


def staged_ids(spark, path):
    return sorted((r.processing_date, r.id) for r in readers.staged(spark, path).collect())


def test_staging_is_incremental_and_repeatable(spark, base):
    path, target = f"{base}/raw", f"{base}/staged"
    assert readers.staged(spark, target) is None
    land(spark, path, volume("a"), volume("b", date="2024-01-02"))
    for _ in range(2):
        stage_dates(spark, readers.raw_volumes(spark, path), target, "2024-01-01", "2024-12-31", full_refresh=True)
        assert staged_ids(spark, target) == [("2024-01-01", "a"), ("2024-01-02", "b")]
    land(spark, path, volume("late", date="2024-01-02", hour="23"), volume("c", date="2024-01-03"))
    stage_dates(spark, readers.raw_volumes(spark, path), target, "2024-01-01", "2024-12-31")
    assert staged_ids(spark, target) == [("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-03", "c")]
    land(spark, path, volume("d", date="2024-01-03", hour="09"))
    stage_dates(spark, readers.raw_volumes(spark, path), target, "2024-01-01", "2024-12-31", on_late="reprocess")
    assert staged_ids(spark, target)[2:] == [("2024-01-03", "c"), ("2024-01-03", "d")]


@pytest.mark.parametrize("files", [None, 1])
def test_stream_keeps_earlier_hours(spark, base, files):
    path, target, marks = f"{base}/raw", f"{base}/staged", f"{base}/marks"
    land(spark, path, volume("a"), volume("b", date="2024-01-02"))
    stage_stream(spark, path, target, marks, files_per_batch=files)
    land(spark, path, volume("late", date="2024-01-01", hour="23"), volume("c", date="2024-01-03"))
    stage_stream(spark, path, target, marks, files_per_batch=files)
    stage_stream(spark, path, target, marks, files_per_batch=files)
    assert staged_ids(spark, target) == [
        ("2024-01-01", "a"), ("2024-01-01", "late"), ("2024-01-02", "b"), ("2024-01-03", "c")]


def test_vector_table(spark, base):
    path, target = f"{base}/raw", f"{base}/staged"
    land(spark, path, volume("a", description="ships " * 30), volume("b", date="2024-01-02", description="<br> " * 30))
    stage_dates(spark, readers.raw_volumes(spark, path), target, "2024-01-01", "2024-12-31")
    assert readers.vector_table(spark, "vectors") is None
    assert build_vectors(spark, target, "2030-01-01", "2030-01-02") == 0
    assert build_vectors(spark, target, "2024-01-01", "2024-01-31") == 1
    assert build_vectors(spark, target, "2024-01-01", "2024-01-31") == 1
    assert readers.vector_table(spark, "vectors").count() == 2
    assert build_vectors(spark, target, "2024-01-01", "2024-01-31", mode="append_new") == 0
    assert readers.vector_table(spark, "vectors").count() == 2


def test_files_and_frames(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.createDataFrame([(1, "x")], "id int, t string").coalesce(1).write.parquet(a)
    spark.createDataFrame([(2, 5)], "id int, n int").coalesce(1).write.parquet(b)
    both = readers.many_files(spark, [a, b])
    assert sorted(both.columns) == ["id", "n", "t"] and both.count() == 2
    assert readers.file_counts(both).count() == 2
    with pytest.raises(ValueError):
        readers.many_files(spark, [])
    frames = readers.append_frames([spark.read.parquet(a), spark.read.parquet(b)])
    assert sorted(tuple(r) for r in frames.collect()) == [(1, "x", None), (2, None, 5)]


def test_json_and_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", AT, ["x", "y"])], "id string, at timestamp, tags array<string>")
    writers.write_json(df, f"{tmp_path}/json")
    back = readers.json_rows(spark, f"{tmp_path}/json", df.schema)
    assert [tuple(r) for r in back.collect()] == [("a", AT, ["x", "y"])]
    plain = spark.createDataFrame([("a,b", 1.5, None)], "title string, rating double, year int")
    plain.write.option("header", True).csv(f"{tmp_path}/csv")
    assert [tuple(r) for r in readers.result_csv(spark, f"{tmp_path}/csv", plain.schema).collect()] == [("a,b", 1.5, None)]


def test_staged_files_prune_partitions(spark, base):
    from conftest import plan_of

    path, target = f"{base}/raw", f"{base}/staged"
    land(spark, path, *[volume(str(k), date=f"2024-01-0{k}") for k in range(1, 6)])
    stage_dates(spark, readers.raw_volumes(spark, path), target, "2024-01-01", "2024-12-31")
    found = readers.staged_files(spark, target, "2024-01-02", "2024-01-04")
    assert found.count() == 3 and found.schema.fieldNames() == STAGING.fieldNames()
    assert "PartitionFilters: [isnotnull(processing_date" in plan_of(found)


def test_a_limited_run_never_replaces_staged_dates(spark, tmp_path):
    raw = spark.createDataFrame([volume(str(k)) for k in range(3)], RAW)
    target = str(tmp_path / "staged")
    stage_dates(spark, raw, target, "2024-01-01", "2024-01-31", limit=1)
    assert readers.staged(spark, target).count() == 1
    with pytest.raises(ValueError):
        stage_dates(spark, raw, target, "2024-01-01", "2024-01-31", limit=1, full_refresh=True)


def test_the_mark_needs_no_scan(spark, tmp_path):
    target = str(tmp_path / "staged")
    spark.range(3).selectExpr("id", "date_format(date_add(date'2024-01-01', cast(id as int)), 'yyyy-MM-dd') as processing_date").write.partitionBy(
        "processing_date").parquet(target)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert high_water_mark(spark.read.schema("id long, processing_date string").parquet(target)) == "2024-01-03"
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_temporary_tables_go_with_their_block(spark):
    def there(df):
        return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())

    with temporary(spark):
        outer = materialize(spark.range(3), "outer")
        with temporary(spark):
            inner = materialize(spark.range(3), "inner")
            handed_on = materialize(inner, "handed-on", lasting=True)
            files = [f.removeprefix("file://") for f in inner.inputFiles()]
        assert files and not any(map(os.path.exists, files))
        assert there(outer) and there(handed_on) and handed_on.count() == 3
        files = [f.removeprefix("file://") for f in handed_on.inputFiles()]
    assert files and not any(map(os.path.exists, files))


def test_late_files_of_old_dates_are_staged(spark, base):
    path, target, manifest = f"{base}/raw", f"{base}/staged", f"{base}/manifest"
    land(spark, path, volume("a"), volume("b", date="2024-01-02"), volume("c", date="2024-01-05"))
    assert stage_unseen(spark, path, target, manifest) == ["2024-01-01", "2024-01-02", "2024-01-05"]
    assert stage_unseen(spark, path, target, manifest) == []
    before = set(spark.read.parquet(target).inputFiles())
    land(spark, path, volume("late", hour="23"))
    assert stage_unseen(spark, path, target, manifest) == ["2024-01-01"]
    assert staged_ids(spark, target) == [("2024-01-01", "a"), ("2024-01-01", "late"), ("2024-01-02", "b"), ("2024-01-05", "c")]
    touched = {f for f in before ^ set(spark.read.parquet(target).inputFiles())}
    assert touched and all("processing_date=2024-01-01" in f for f in touched)
    assert spark.read.parquet(manifest).count() == 4


def test_a_merge_leaves_other_buckets_alone(spark, base):
    table = "ledger_in_buckets"
    row = lambda k, n: (k, f"author {n}", AT, n, None, None)
    names = LEDGER.fieldNames()
    writers.save_ledger(spark, spark.createDataFrame([row(k, k) for k in range(60)], LEDGER), table)
    files = lambda: {r.f: r.bucket for r in spark.table(table).select(F.input_file_name().alias("f"), "bucket").distinct().collect()}
    before = files()
    writers.save_ledger(spark, spark.createDataFrame([row(7, 700), row(1000, 1)], LEDGER), table)
    after = files()
    stored = readers.ledger_table(spark, table)
    assert stored.columns == names
    got = {r.processing_order: (r.author_name, r.raw_books_count, r.deduplicated_books_count) for r in stored.collect()}
    assert got == {k: (f"author {k}", k, 0) for k in range(60) if k != 7} | {7: ("author 700", 700, 0), 1000: ("author 1", 1, 0)}
    changed = {r.bucket for r in spark.table(table).where("processing_order in (7, 1000)").select("bucket").collect()}
    assert {f for f, b in before.items() if b not in changed} == {f for f, b in after.items() if b not in changed}
    assert not {f for f, b in before.items() if b in changed} & set(after)
    writers.save_ledger(spark, spark.createDataFrame([], LEDGER), table)
    assert files() == after


def test_a_merge_that_dies_leaves_the_old_rows(spark, base, monkeypatch):
    table = "ledger_that_dies"
    row = lambda k, n: (k, f"author {n}", AT, n, 0, 0)
    writers.save_ledger(spark, spark.createDataFrame([row(k, k) for k in range(20)], LEDGER), table)

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(writers, "_location", dies)
    with pytest.raises(RuntimeError):
        writers.save_ledger(spark, spark.createDataFrame([row(3, 300)], LEDGER), table)
    assert {r.author_name for r in readers.ledger_table(spark, table).collect()} == {f"author {k}" for k in range(20)}


def test_files_of_clashing_types(spark, tmp_path):
    rows = {
        "a": ("id int, v int, s struct<x:int>", [(1, 5, (1,))]),
        "b": ("id long, v double, s struct<x:long,y:string>", [(2, 0.5, (2, "y"))]),
        "c": ("id int, v string, l array<int>", [(3, "x", [1])]),
        "d": ("id int, v int, l array<double>", [(4, None, [0.5])]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = readers.many_files(spark, [f"{tmp_path}/{n}" for n in rows])
    assert got.schema.simpleString() == "struct<id:bigint,v:string,s:struct<x:bigint,y:string>,l:array<double>>"
    assert {tuple(r) for r in got.select("id", "v", "s.x", "s.y", F.to_json("l")).collect()} == {
        (1, "5", 1, None, None), (2, "0.5", 2, "y", None), (3, "x", None, None, "[1.0]"), (4, None, None, None, "[0.5]")}


def test_files_in_range_need_a_file(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/x/2024-02-03")
    assert readers.files_in_range(spark, str(tmp_path), "2024-02-01", "2024-02-28").select("id", "file_date").count() == 3
    with pytest.raises(ValueError):
        readers.files_in_range(spark, str(tmp_path), "2025-02-01", "2025-02-28")


def test_author_lists_are_numbered_without_python(spark, tmp_path):
    for k, part in enumerate(("a", "b", "c")):
        (tmp_path / f"{part}.txt").write_text("\n".join(f" {k}-{n} " for n in range(50)))
    got = readers.author_list(spark, str(tmp_path))
    assert [tuple(r) for r in got.orderBy("processing_order").collect()] == [(50 * k + n, f"{k}-{n}") for k in range(3) for n in range(50)]
    assert "Python" not in plan_of(got, "simple")


def test_places_in_a_group_that_holds_most_rows(spark):
    rows = [("big", (k * 37) % 5003) for k in range(5000)] + [("small", 3), ("small", 1), (None, 9)]
    got = places(spark.createDataFrame(rows, "g string, o long").repartition(9), "g", "o").collect()
    want = {(g, o): k for name in ("big", "small", None) for k, (g, o) in enumerate(sorted(r for r in rows if r[0] == name))}
    assert {(r.g, r.o): r.place for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("files", [None, 1])
def test_stream_by_state_adds_late_hours_from_new_files_only(spark, base, files):
    path, target, marks = f"{base}/raw", f"{base}/staged", f"{base}/marks"
    run = lambda: append_stream(spark, path, target, marks, files_per_batch=files)
    land(spark, path, volume("a"), volume("b", date="2024-01-02"), volume("c", date="2024-01-05"))
    assert run() == 3 and run() == 0
    before = set(spark.read.parquet(target).inputFiles())
    land(spark, path, volume("late", hour="23"), volume("a", hour="23"), volume("b", date="2024-01-02", hour="22"))
    assert run() == 3  # the rows of the new files
    batch = stage_rows(readers.raw_volumes(spark, path))
    got = spark.read.schema(STAGING).parquet(target)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() == 4
    assert before <= set(spark.read.parquet(target).inputFiles())


def test_rows_later_than_the_stream_remembers_are_reported(spark, base):
    path, target, marks = f"{base}/raw", f"{base}/staged", f"{base}/marks"
    land(spark, path, volume("a", date="2024-03-01"))
    append_stream(spark, path, target, marks, delay="5 days")
    land(spark, path, volume("b", date="2024-01-01"))
    with pytest.raises(LateRows):
        append_stream(spark, path, target, marks, delay="5 days")
