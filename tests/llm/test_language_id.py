"""Rank-order profiles against a plain model."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from brute import clashing, frame, odd_documents
from pyspark.sql import functions as F

from shelf.llm import language_id as lid


def number(gram):
    slots = [1 if c == " " else ord(c) + 1 for c in gram] + [0] * (3 - len(gram))
    return slots[0] << 42 | slots[1] << 21 | slots[2]


def grams(text):
    out = Counter()
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    for word in letters.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            out.update(number(g) for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != " ")
    return out


def top(counts, size):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def model(rows, size):
    learned = defaultdict(Counter)
    for doc_id, text, lang, *_ in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2 and lang is not None:
            learned[lang] += grams(text)
    profiles = {lang: top(c, size) for lang, c in learned.items() if c}
    out = []
    for doc_id, text, *_ in rows:
        own = top(grams(text), size)
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
        if not own or not profiles:
            out.append((doc_id, held, "und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((doc_id, held, best, round(1 - far[best] / (size * len(own)), 9)))
    return Counter(out)


def test_predictions_equal_a_plain_model(spark):
    rng = random.Random(4)
    tongues = {"xx": "abcde ", "yy": "défgà -", "zz": "жзиÀß 1", "": "中文字本日 "}
    rows = [(k, "".join(rng.choices(letters, k=rng.randint(0, 300))), lang, None, None) for k in range(120) for lang, letters in tongues.items()]
    rows += odd_documents() + [(900, "1234 ... !!", "xx", None, None), (901, "a", None, None, None), (902, "𝔸𝕓 İstanbul ǅ", "xx", None, None)]
    documents = clashing(frame(spark, rows)).withColumn("lang_pred", F.lit("q"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    for size in (20, 400):
        got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in lid.judge(documents, held, size).collect())
        assert got == model(rows, size)


def test_without_anything_to_learn(spark):
    held = F.lit(False)
    rows = [(1, "some words", None, None, None), (2, None, "en", None, None)]
    assert {(r.doc_id, r.lang_pred, r.score) for r in lid.judge(frame(spark, rows), held).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert lid.judge(frame(spark, []), held).count() == 0


def test_counting_in_pieces_and_with_many_letters(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(map(chr, rng.choices(range(0x4E00, 0x9FFF), k=4000))) + " a b" for _ in range(5)] + [None, ""]
    want = [(k, g, n) for k, t in enumerate(texts) for g, n in sorted(grams(t).items())]

    def got(group):
        return list(zip(*(x.tolist() for x in lid.gram_counts(texts, group)), strict=True))

    assert got(np.arange(7)) == want
    monkeypatch.setattr(lid, "PIECE", 101)
    assert got(np.arange(7)) == want
    far = np.arange(7) * 2**30  # groups that do not fit one number with three letters
    assert got(far) == [(k * 2**30, g, n) for k, g, n in want]


def test_held_out_documents_are_told_apart(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = lid.judge(documents, held).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
