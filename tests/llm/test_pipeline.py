"""The pipeline against its brute-force version, stage by stage and as a whole."""

import hashlib
import math

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from brute import frame, mixed, near_groups, odd_documents, without_repeated_lines, words

from shelf.llm import quality_model
from shelf.llm.queries import WEIGHTS

tokenizers = pytest.importorskip("tokenizers")


def domain(source):
    digits = source[len(source.rstrip("0123456789")) :] if source else ""
    return {1: "books", 2: "forums"}.get(int(digits) % 3 if digits else 0, "web")


def kept_by_lines(rows):
    """Rows (doc_id, text, lang, source) without repeated lines; what lost all its words goes."""
    cut = without_repeated_lines([r[:2] for r in rows])
    return [(i, cut[i][0], lang, s) for i, _, lang, s in rows if not (cut[i][1] and not words(cut[i][0]))]


def kept_by_mix(rows):
    counted = [(i, domain(s), lang or "", s or "", len(words(t))) for i, t, lang, s in rows]
    return {i: n for i, _, n in mixed(counted, WEIGHTS, 0.9, 1, 7)}


def test_whole_run_equals_brute_force(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in source.orderBy("doc_id").collect()]
    forest = quality_model.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = forest.score(quality_model.document_statistics(pd.Series([r[1] for r in rows])))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    group = near_groups([r[:2] for r in rows])
    rows = [r for r in rows if group[r[0]] == r[0]]
    rows = kept_by_lines(rows)
    taken = kept_by_mix(rows)
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {}
    for i, text, *_ in rows:
        if taken.get(i, 0):
            whole = len(words(text)) == taken[i]
            want[i] = library.encode(text, add_special_tokens=False).ids if whole else None
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i for i, r in got.items() if r.n_tokens} == set(want)
    for i, ids in want.items():
        if ids is not None:
            assert got[i].ids == ids
            assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert 0 < len(want) < source.count()
    assert sum(ids is None for ids in want.values()) <= 80  # at most one cut document a leaf
    assert sum(taken.values()) == math.floor(0.9 * sum(len(words(r[1])) for r in rows))


def test_stages_take_odd_rows_and_an_empty_table(spark, sf_dir):
    for rows in (odd_documents(), []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "bpe_coding":
                assert out.dtypes == docs.dtypes, name
            assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}, name


def test_each_stage_has_an_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    again = [(10_000 + i, t, lang, s, n) for i, t, lang, s, n in rows[:20]]
    twice = frame(spark, rows + again)
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, twice, sf_dir)
        counts[name] = (out.count(), sum(len(words(r.text)) for r in out.collect()))
    total = sum(len(words(r[1])) for r in rows + again)
    assert all(n < len(rows) + 20 and w < total for n, w in counts.values())
    assert np.isclose(counts["source_mixing"][1], 0.9 * total, rtol=0.05)
