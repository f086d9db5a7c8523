import zlib

import numpy as np
import pandas as pd
from brute import clashing, frame, odd_documents, prose

from shelf.llm import quality_model as model


def walk(forest, row):
    """One row through every tree, node by node."""
    total = forest.base
    for t in range(len(forest.value)):
        node = 0
        for _ in range(forest.depth):
            node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
        total += forest.value[t, node - 2**forest.depth + 1]
    return 1 / (1 + np.exp(-total))


def test_arrays_equal_a_walk_over_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = model.grow_forest(x, y, trees=30, depth=3)
    scores = forest.score(x)
    assert np.allclose(scores, [walk(forest, r) for r in x])
    assert ((scores > 0.5) == y).mean() > 0.97


def corpus(spark):
    rows, labels = [], []
    for i in range(200):
        good = i % 4 != 0
        rows.append((i, prose(i, 90) if good else " ".join([prose(i, 3)] * 30).upper(), "en", "s", None))
        labels.append((i, int(good)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    got = model.score_documents(clashing(docs), labels).collect()
    assert len(got) == 200
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) == int(r.doc_id % 4 != 0)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(spark)
    wrong = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    same = [{r.doc_id: r.score for r in model.score_documents(docs, x).collect()} for x in (labels, wrong)]
    assert same[0] == same[1]


def test_odd_rows_and_labels(spark):
    docs, labels = corpus(spark)
    rows = odd_documents()
    odd = labels.union(spark.createDataFrame([(None, 1), (7, None), (1, 0), (1, 1), (1, 1)], "doc_id long, quality int"))
    got = model.score_documents(docs.union(frame(spark, rows)), odd).collect()
    assert len(got) == 200 + len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = model.keep_good(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.count() == 150


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark)
    none = labels.where("false")
    assert {r.score for r in model.score_documents(docs, none).collect()} == {0.5}
    assert model.score_documents(frame(spark, []), labels).collect() == []
    one_class = model.score_documents(docs, labels.where("quality = 1")).collect()
    assert min(r.score for r in one_class) > 0.9


def test_statistics_of_odd_texts():
    x = model.document_statistics(pd.Series(["", None, " \n ", "a" * 100_000, "!"]))
    assert np.isfinite(x).all() and not x[:2].any()
