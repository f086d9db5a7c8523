import random

import numpy as np
import pytest
from brute import ascii_lower, clashing, fingerprint, frame, groups, odd_documents, prose, words

from shelf.llm import simhash


def expected(rows, reach=3):
    prints = {i: fingerprint(t, 3) for i, t in rows if i is not None}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= reach]
    of = groups(prints, near)
    return {i: (f"{p:016x}", of[i]) for i, p in prints.items()}


def edited(text, rng, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


@pytest.fixture(scope="module")
def families():
    rng, rows = random.Random(1), []
    for family in range(12):
        base = prose(family, 300)
        rows += [edited(base, rng, k) for k in (0, 0, 1, 1, 2, 4, 8, 16)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 3])
def test_components_equal_brute_force(spark, families, block):
    docs = frame(spark, [(i, t, None, None, None) for i, t in families])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(docs, block=block).collect()}
    assert got == expected(families)
    assert len({c for _, c in got.values()}) < len(families) - 12


def test_odd_rows(spark):
    rows = odd_documents()
    got = simhash.near_copies(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = expected([(r[0], r[1]) for r in rows])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == want[r.doc_id]
    assert [r.fingerprint for r in got if r.doc_id in (1, 2, 6)] == ["0" * 16] * 3


def test_empty_table(spark):
    assert simhash.near_copies(frame(spark, [])).collect() == []
    assert simhash.drop_near_copies(frame(spark, [])).collect() == []


def test_pivot_distances_never_discard_a_link():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 500, np.uint64)
    other = one ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64))
    tables = [simhash.pivot_distances(x, simhash.pivots()).astype(int) for x in (one, other)]
    assert np.abs(tables[0] - tables[1]).max() <= 2


def test_dropping_keeps_one_of_each_group_and_all_columns(spark, families):
    rows = odd_documents()
    docs = clashing(frame(spark, rows))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(((r.doc_id is not None, r.doc_id) for r in kept.collect()), key=str)
    known = [i for has, i in ids if has]
    assert sorted(known) == [1, 3, 4, 7, 8, 9]  # 2 and 6 are empty like 1, 5 equals 4
    assert len(ids) - len(known) == 2


def test_words_are_cut_at_ascii_spaces_only():
    text = "A b c\x1fd É"
    assert words(ascii_lower(text)) == ["a b", "c\x1fd", "É"]
    assert simhash.majority(simhash.shingle_hashes(text, 3)) == fingerprint(text, 3)
