import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from shelf.functions.encode import hashing_encoder, sentence_encoder
from shelf.operators.vectors import CARD_COLUMNS, _packed, block_pairs, embed, nearest, pivots, result_cards, search
from shelf.plans.search import recommend, vectorize
from shelf.schemas import STAGING

SCHEMA = "id string, vector array<float>"


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, query, k, metric):
    def d(v):
        v, q = np.array(v, dtype="float32").astype("float64"), np.array(query, dtype="float64")
        if metric == "l2":
            return float(np.sqrt(((v - q) ** 2).sum()))
        if metric == "dot":
            return float(-(v * q).sum())
        n = np.sqrt((v * v).sum() * (q * q).sum())
        return float("nan") if n == 0 else float(1 - (v * q).sum() / n)

    found = sorted((d(v), i) for i, v in rows if v is not None and d(v) == d(v))
    return [(i, round(x, 9)) for x, i in found[:k]]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("sizes", [{}, {"block": 60, "query_block": 2}])
def test_nearest_equals_a_full_scan(spark, metric, sizes):
    rnd = random.Random(9)
    rows = [(f"v{k:04}", [rnd.gauss(0, 1) for _ in range(8)]) for k in range(900)]
    rows += [(f"w{k:04}", rows[k][1]) for k in range(300)] + [("zero", [0.0] * 8), ("none", None)]
    asked = [(k, [float(x) for x in np.float32([rnd.gauss(0, 1) for _ in range(8)])]) for k in range(5)]
    asked.append((5, [float(x) for x in np.float32(rows[0][1])]))
    queries = spark.createDataFrame(asked, "qid int, vector array<double>")
    found = nearest(vectors(spark, rows).repartition(5), queries, 5, metric, **sizes).collect()
    for qid, q in asked:
        got = [(r.id, round(r.distance, 9)) for r in sorted(found, key=lambda r: r.rank) if r.qid == qid]
        assert got == brute(rows, q, 5, metric)


def test_ties_go_by_id_and_k_may_exceed_the_table(spark):
    rows = [(f"c{k:03}", [0.1, 0.2, 0.3]) for k in range(50)]
    q = spark.createDataFrame([(1, [0.3, 0.2, 0.1])], "qid int, vector array<float>")
    got = nearest(vectors(spark, rows).repartition(4), q).orderBy("rank").collect()
    assert [r.id for r in got] == ["c000", "c001", "c002", "c003", "c004"]
    assert nearest(vectors(spark, rows[:2]), q).count() == 2


def test_blocks_that_are_too_far_are_skipped(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 6)) * 50
    rows = [(f"v{k:05}", (centres[k % 12] + rng.standard_normal(6) * 0.1).tolist()) for k in range(3000)]
    asked = [(k, [float(x) for x in np.float32(centres[k % 2])]) for k in range(40)]
    named = vectors(spark, rows).select(F.col("id").alias("name"), F.col("vector").cast("array<double>").alias("vector"))
    centres_ = pivots(named, 100)
    there = _packed(named, "l2", 100, centres_)
    questions = spark.createDataFrame(asked, "name int, vector array<double>")
    for metric in ("l2", "dot"):
        pairs = block_pairs(_packed(questions, metric, 20, centres_), there, 3, metric)
        blocks = there.count()
        assert 0 < pairs.select("block").distinct().count() < blocks / 2
    for metric in ("l2", "cosine", "dot"):
        found = nearest(vectors(spark, rows), questions.withColumnRenamed("name", "qid"), 3, metric, block=100, query_block=20).collect()
        for qid, q in asked[:4]:
            got = [(r.id, round(r.distance, 9)) for r in sorted(found, key=lambda r: r["rank"]) if r.qid == qid]
            assert got == brute(rows, q, 3, metric)


def test_blocks_are_bounded_and_queries_stay_out_of_the_driver(spark, monkeypatch):
    rows = [("same", [1.0, 2.0])] * 500 + [(f"v{k}", [float(k), 1.0]) for k in range(300)]
    named = vectors(spark, rows).select(F.col("id").alias("name"), F.col("vector").cast("array<double>").alias("vector"))
    sizes = [r.n for r in _packed(named, "l2", 50, pivots(named, 50)).collect()]
    assert sum(sizes) == 800 and max(sizes) <= 100

    def refused(*_):
        raise AssertionError("rows reached the driver")

    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(named), name, refused)
    fetched, real = [], type(named).toArrow
    monkeypatch.setattr(type(named), "toArrow", lambda self: fetched.append(real(self)) or fetched[-1])
    q = spark.createDataFrame([(1, [0.3, 0.2])], "qid int, vector array<float>")
    out = nearest(vectors(spark, rows), q, 2)
    monkeypatch.undo()
    assert [t.num_rows for t in fetched] == [1] and [0.3, 0.2] not in fetched[0].column("vector").to_pylist()
    assert "WindowGroupLimit" in plan_of(out) and out.count() == 2


def test_encoder_is_pluggable_and_loaded_once_per_task(spark):
    def make():
        calls = []

        def encode(texts):
            calls.append(1)
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = spark.createDataFrame([("a", "xx"), ("b", None)], "id string, processed_text string")
    assert [r.vector for r in embed(df, make=make).orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_hashing_encoder():
    encode = hashing_encoder(16)
    a, b, c = encode(["the sea", "The  SEA", ""])
    assert np.array_equal(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and not c.any()


def test_sentence_encoder_is_optional():
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            sentence_encoder()


def test_search_finds_the_text_itself(spark):
    texts = ["a whale at sea", "gardens of rome", "the long winter", "a history of salt"]
    docs = embed(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, processed_text string"))
    asked = spark.createDataFrame([(7, "Gardens of Rome")], "qid int, query string")
    first = search(docs, asked, limit=1).first()
    assert (first.qid, first["rank"], first.id) == (7, 1, "1") and first.distance < 1e-3


def test_cards(spark):
    rows = [("1", 4.5, 3, "d" * 151), ("2", 4.0, 0, "short"), ("3", None, 5, None)]
    books = spark.createDataFrame(rows, "id string, avg_rating double, ratings_count int, description string")
    for name in CARD_COLUMNS:
        if name not in books.columns:
            books = books.withColumn(name, F.lit("x"))
    found = spark.createDataFrame([(1, k + 1, str(k + 1), 0.1) for k in range(3)], "qid int, rank int, id string, distance double")
    out = result_cards(found, books).orderBy("rank").collect()
    assert [r.rating_text for r in out] == ["⭐ 4.5 (3 ratings)", "⭐ 4", None]
    assert [r.has_more for r in out] == [True, False, False]
    assert out[0].preview == "d" * 150 + "..." and out[1].preview == "short..."


def test_recommend_from_staged_rows(spark):
    row = {f.name: None for f in STAGING}
    rows = [{**row, "id": str(k), "title": f"t{k}", "description": d, "ratings_count": 0}
            for k, d in enumerate(["ships and <b>storms</b>", "bread", " <br> "])]
    table = vectorize(spark.createDataFrame(rows, STAGING))
    assert table.count() == 2
    asked = spark.createDataFrame([(1, "storms ships and")], "qid int, query string")
    assert [r.title for r in recommend(table, asked, limit=1).collect()] == ["t0"]
