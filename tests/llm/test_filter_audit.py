"""The filter audit and its tries against plain models."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from brute import clashing, frame, odd_documents, prose, words
from pyspark.sql import functions as F

from shelf.llm import filter_audit
from shelf.llm.radix import RadixTrie, cut_points, range_of, shared_length


def failed(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = words(text)
        out.append("".join(name for name, fails in (
            ("A", len(w) < 200),
            ("B", 100 * len(set(w)) < 50 * len(w)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
            ("D", re.search(r"[#$%&*|]", text) is not None),
            ("E", doc_id is not None and first[text] < doc_id),
        ) if fails))
    return out


def model(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = [(r[2] or "", set(f), r[0] in good, r[0] in toxic) for r, f in zip(rows, failed(rows), strict=True)]
    out, by_filter = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                removed = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                by_filter[part, name] += len(removed)
                out[part, "".join(order), step] = (
                    len(left), len(removed), sum(name in d[0] for d in mine) - len(removed), sum(d[0] == {name} for d in mine),
                    sum(d[1] for d in removed), sum(d[2] for d in removed),
                )
    return {(p, o, s, *v, by_filter[p, o[s - 1]]) for (p, o, s), v in out.items()}


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(150):
        text = prose(k % 90, rng.choice([50, 250, 250]), rng.choice([60, 400]))
        text = text.title() if rng.random() < 0.2 else text + " a|b" if rng.random() < 0.2 else text
        rows.append((1000 - k, text, rng.choice(["en", "de", None, ""]), None, None))
    rows += [(k, rows[k % 5][1], "en", None, None) for k in range(2000, 2100)]  # many copies
    return rows + odd_documents() + [(3000, "Ä ä #", "de", None, None), (None, "Ä ä #", "de", None, None), (3000, "Ä ä #", "fr", None, None)]


@pytest.mark.parametrize("how", [{}, {"trie_bytes": 3000, "range_bytes": 2000}])
def test_report_equals_a_plain_model(spark, how):
    rows = corpus()
    rng = random.Random(8)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows[::2]]
    documents = clashing(frame(spark, rows)).withColumn("mask", F.lit(3)).repartition(9)
    given = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(documents, given, **how).collect()]
    assert len(got) == len(set(got)) == 600 * len({r[2] or '' for r in rows})
    assert set(got) == model(rows, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    assert filter_audit.audit(frame(spark, [(1, None, None, None, None)]), labels).count() == 600


def test_shares_add_up(spark):
    """Over all filters the removals are those of documents that fail anything, once in each order."""
    rows = corpus()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(frame(spark, rows), labels).where("filter_order = 'ABCDE'")
    assert out.agg(F.sum("shapley")).first()[0] == 120 * sum(bool(f) for f in failed(rows))


def test_trie_finds_and_reads_back():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(3000)] + [b"", b"x" * 100_000, b"x" * 99_999 + b"y"]
    trie, least, place = RadixTrie(), {}, {}
    for name, text in enumerate(texts):
        name = (name * 7919) % 3001
        node = trie.insert(text, name)
        assert place.setdefault(text, node) == node
        least[text] = min(least.get(text, name), name)
    assert {t: trie.least[n] for t, n in place.items()} == least
    assert all(trie.text(n) == t for t, n in place.items())
    assert len(trie.edge) <= 2 * len(place) + 1


def test_shared_length():
    rng = random.Random(2)
    for _ in range(3000):
        a, b, at = bytes(rng.choices(b"ab", k=rng.randint(0, 60))), bytes(rng.choices(b"ab", k=rng.randint(0, 90))), rng.randint(0, 3)
        a = b[at : at + rng.randint(0, 50)] + a
        want = next((k for k in range(min(len(a), max(len(b) - at, 0))) if a[k] != b[at + k]), min(len(a), max(len(b) - at, 0)))
        assert shared_length(a, b, at) == want


def test_cuts_follow_crowded_prefixes(spark):
    """Texts of one long opening are dealt out all the same, and equal texts stay together."""
    opening = "the same opening for all of them, " * 20
    texts = [opening + prose(k, 30) for k in range(400)] + ["copies " * 50] * 300
    frame_ = spark.createDataFrame([(t,) for t in texts], "text string")
    cuts = cut_points(frame_, "text", range_bytes=20_000, samples=16)
    assert cuts == sorted(set(cuts)) and all(len(c) <= 700 for c in cuts)
    dealt = Counter(range_of(t.encode(), cuts) for t in texts[:400])
    assert len(dealt) > 10 and max(dealt.values()) < 80
