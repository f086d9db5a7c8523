from collections import Counter

from brute import clashing, divide, frame, mixed, odd_documents, prose, words
from pyspark.sql import functions as F

from shelf.llm import mixing

WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 4}, "source": {"s1": 2}}


def corpus(spark, count=300):
    rows = [
        (i, prose(i, (i * 7) % 60), "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else "s0", None) for i in range(count)
    ]
    return rows, frame(spark, rows)


def domain():
    return F.when(F.col("source").isin("s0", "s1"), "a").otherwise("b")


def plain(rows):
    return [
        (i, "a" if s in ("s0", "s1") else "b", lang or "", s or "", len(words(t))) for i, t, lang, s, _ in rows
    ]


def test_equals_brute_force(spark):
    rows, docs = corpus(spark)
    for share, epochs, digits in ((0.6, 2, 3), (1.4, 2, 1), (0.05, 1, 2), (5.0, 2, 3)):
        got = mixing.mix(mixing.word_counts(docs, domain()), WEIGHTS, share=share, epochs=epochs, digits=digits, seed=11)
        have = Counter((r.doc_id, r.epoch, r["take"]) for r in got.collect())
        want = Counter(mixed(plain(rows), WEIGHTS, share, epochs, 11))
        # a document without words costs nothing; whether it is taken at the very end is settled by its place
        assert {k: n for k, n in have.items() if k[2]} == {k: n for k, n in want.items() if k[2]}


def test_shortage_goes_to_siblings_first():
    # the domain's small language is short; its sibling takes that up, the other domain gets its own part only
    assert divide(100, {"x": (10, 1), "y": (1000, 1)}) == {"x": 10, "y": 90}
    assert divide(100, {"x": (10, 1), "y": (20, 1)}) == {"x": 10, "y": 20}


def test_budgets_add_up(spark):
    rows, docs = corpus(spark)
    counted = mixing.word_counts(docs, domain())
    leaves = counted.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    total = sum(r[4] for r in plain(rows))
    for share in (0.3, 1.0, 1.9):
        got = mixing.budgets(leaves, WEIGHTS, share=share, epochs=2).collect()
        assert sum(r.budget for r in got) == int(total * share)
        assert all(0 <= r.budget <= 2 * r.tokens for r in got)


def test_documents_are_cut_where_the_budget_ends(spark):
    rows, docs = corpus(spark)
    out = mixing.mix_documents(clashing(docs), domain(), WEIGHTS, share=0.5, epochs=1, seed=11)
    assert out.columns == clashing(docs).columns
    texts = {r[0]: r[1] for r in rows}
    taken = {i: n for i, _, n in mixed(plain(rows), WEIGHTS, 0.5, 1, 11) if n}
    got = {r.doc_id: r.text for r in out.collect() if words(r.text)}
    assert {i: len(words(t)) for i, t in got.items()} == taken
    assert all(texts[i].startswith(t) for i, t in got.items())


def test_odd_rows(spark):
    rows = odd_documents()
    docs = clashing(frame(spark, rows))
    out = mixing.mix_documents(docs, domain(), WEIGHTS, share=0.7, epochs=2).collect()
    assert sum(len(words(r.text)) for r in out) >= int(0.7 * sum(len(words(r[1])) for r in rows))
    assert {r.doc_id for r in out} <= {r[0] for r in rows}


def test_empty_table(spark):
    docs = frame(spark, [])
    assert mixing.mix(mixing.word_counts(docs, domain()), WEIGHTS).collect() == []
    assert mixing.mix_documents(docs, domain(), WEIGHTS).collect() == []
