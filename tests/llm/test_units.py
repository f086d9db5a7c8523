import os
import random

import numpy as np
from brute import clashing, frame, odd_documents, prose, without_repeated_lines
from conftest import plan_of

from shelf.llm import units
from shelf.scratch import run_folder


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [prose(k, rng.randint(2, 12), 30).replace("\n", " ") for k in range(60)]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f"  {x} "]) for x in rng.choices(pool, k=rng.randint(0, 9)))) for i in range(80)]
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows])
    want = without_repeated_lines(rows)
    texts = dict(rows)
    for r in units.remove_repeats(docs).collect():
        text, gone = want[r.doc_id]
        assert r.text == text and [tuple(x) for x in r.removed] == gone
        for start, end, first_doc, _ in gone:
            assert " ".join(texts[r.doc_id][start:end].lower().split()) in " ".join(texts[first_doc].lower().split())


def test_passages_at_random_places_are_found(spark):
    """55 words from the middle of one text in the middle of another: nearly all lose most of them, also without full stops."""
    rng, rows, own = random.Random(7), [], {}
    for k in range(300):
        source = prose(k, 120).replace("\n", " ").replace(".", "" if k % 2 else ".").split()
        at = rng.randrange(60)
        around = prose(1000 + k, 90).replace("\n", " ").split()
        where = rng.randrange(90)
        rows += [(k, " ".join(source)), (1000 + k, " ".join(around[:where] + source[at : at + 55] + around[where:]))]
        own[1000 + k] = around
    got = {r.doc_id: r.text for r in units.remove_repeats(frame(spark, [(*r, None, None, None) for r in rows])).collect()}
    assert all(got[k] == t for k, t in rows if k < 1000)
    left = [len(got[k].split()) - 90 for k in own]
    assert sum(n < 55 for n in left) >= 297 and sum(n <= 25 for n in left) >= 270 and min(left) >= -16


def test_common_sentences_and_short_lines_stay(spark):
    common = "all rights are reserved by the owner of this page."
    texts = [f"{prose(k, 40)} {common} {prose(k + 50, 40)}\n{common}\n{prose(k + 100, 30)}" for k in range(30)]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    assert {r.doc_id: r.text for r in units.remove_repeats(docs).collect()} == dict(enumerate(texts))


def test_a_passage_of_short_lines_goes(spark):
    verse = "\n".join(prose(k, 6).replace("\n", " ") for k in range(200, 209))
    docs = frame(spark, [(k, f"{prose(k, 30)}\n{verse}\n\n{prose(k + 50, 30)}", None, None, None) for k in range(3)])
    got = [r.text for r in units.remove_repeats(docs).orderBy("doc_id").collect()]
    assert verse in got[0] and got[1:] == [f"{prose(k, 30)}\n\n{prose(k + 50, 30)}" for k in (1, 2)]


def test_odd_rows(spark):
    rows = odd_documents()
    docs = clashing(frame(spark, rows))
    out = units.remove_repeats(docs)
    assert set(out.columns) == set(docs.columns)
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.text for r in by_id[None]} == {rows[2][1], None}
    assert [r.text for r in by_id[5]] == ["", ""]  # a copy of 4, twice
    assert by_id[4][0].text == rows[4][1] and by_id[4][0].n == -1
    assert by_id[9][0].text == rows[10][1]  # its repeated line has 13 words
    assert by_id[2][0].text is None and by_id[1][0].text == "" and by_id[6][0].text == rows[7][1]


def test_rows_of_one_id_with_different_texts(spark):
    first, second = prose(1, 39), prose(2, 39)
    docs = frame(spark, [(1, first, None, None, None), (1, second, None, None, None), (2, second + "\n" + first, None, None, None)])
    got = {(r.doc_id, r.text) for r in units.remove_repeats(docs).collect()}
    assert got == {(1, first), (1, second), (2, "")}


def test_paragraphs(spark):
    a, b = prose(1, 20).replace("\n", " "), prose(2, 20).replace("\n", " ")
    docs = frame(spark, [(1, f"{a}\n\n{b}", None, None, None), (2, f"x\n\n{b}\n \ny\n\n{a}", None, None, None)])
    got = {r.doc_id: r.text for r in units.remove_repeats(docs, unit="paragraph").collect()}
    assert got == {1: f"{a}\n\n{b}", 2: "x\n \ny"}


def test_empty_table(spark):
    assert units.remove_repeats(frame(spark, [])).collect() == []


def test_texts_are_cut_into_units_once(spark):
    docs = frame(spark, [(k, prose(k % 3, 60), None, None, None) for k in range(9)])
    found = units.repeated_units(docs)
    assert "MapInPandas" not in plan_of(found) and not found.isEmpty()


def test_heads_are_the_least_ranks_of_a_part():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 200):
        high, low, ids, starts = (rng.integers(0, m, n) for m in (9, 3, 20, 5))
        heads = units.heads_of(high, low, ids, starts)
        least = {}
        for k in range(n):
            rank, (best, at) = (ids[k], starts[k]), least.get((high[k], low[k]), ((99, 0), None))
            least[high[k], low[k]] = min((rank, heads[k]), (best, at), key=lambda x: x[0])
        for k in range(n):
            rank, head = least[high[k], low[k]]
            assert heads[k] == head and (ids[head], starts[head]) == rank


def test_a_line_of_every_text_brings_one_row_a_part_to_the_grouping(spark, monkeypatch):
    """Three parts of up to 500 rows, each with copies of its own, of other parts' and inside of texts."""
    written, write = {}, units.materialize
    monkeypatch.setattr(units, "materialize", lambda df, name, **kw: written.setdefault(name, write(df, name, **kw)))
    line = prose(9_999, 20).replace("\n", " ")
    rows = [(k, f"{prose(k % 900, 20, 30)}\n{line}" + f"\n{line}" * (k % 50 == 0)) for k in range(1200)]
    random.Random(5).shuffle(rows)
    docs = frame(spark, [(k, t, None, None, None) for k, t in rows]).coalesce(1)
    found = units.repeated_units(docs)
    sent = written["units"].where("head_doc_id is null").groupBy("high", "low").count()
    assert sent.agg({"count": "max"}).first()[0] == 3
    assert "IsNotNull(head_doc_id)" in plan_of(found)  # of the units, only what is no head is read again
    want = without_repeated_lines(rows)
    for r in units.remove_repeats(docs).collect():
        assert (r.text, [tuple(x) for x in r.removed]) == want[r.doc_id]


def test_rows_that_repeat_an_id_in_several_parts(spark):
    line = prose(4, 20).replace("\n", " ")
    rows = [(7, f"{line}\n{line}")] * 1100 + [(8, line), (7, prose(5, 25))]
    docs = frame(spark, [(*r, None, None, None) for r in rows]).coalesce(1)
    found = units.repeated_units(docs)
    assert found.where("doc_id = 7 and start = 0").isEmpty()
    whole = found.where(f"doc_id = 8 and start = 0 and end = {len(line)}")
    assert whole.select("first_doc_id", "first_start").distinct().collect() == [(7, 0)]
    got = {(r.doc_id, r.text) for r in units.remove_repeats(docs).collect()}
    assert got == {(7, line), (8, ""), (7, prose(5, 25))}


def test_units_are_dropped_before_the_texts_are_moved(spark):
    folder = run_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    out = units.remove_repeats(frame(spark, [(k, prose(k % 3, 60), None, None, None) for k in range(9)]))
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"repeats"}
    assert out.where("text = ''").count() == 6
