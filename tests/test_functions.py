import random
import re
import unicodedata

from pyspark.sql import functions as F

from shelf.functions import text as text_fn
from shelf.functions.values import first_or, publication_year, published_date


def one(spark, values, make, kind="string"):
    rows = [(k, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"k int, v {kind}").select("k", make(F.col("v")).alias("out"))
    return [r.out for r in df.orderBy("k").collect()]


CLEAN = {
    None: "",
    "<b>x</b>": "x",
    "a http://u/v b": "a b",
    "café ½ x_y": "café ½ x_y",
    "a — b": "a b",
    '"" x': '" x',
    "hi !": "hi!",
    "a   b": "a b",
    "it''s \"fine\" , ok ?": "it\"s \"fine\" , ok?",
    "  \x1c ": "",
}


def test_clean_text(spark):
    assert one(spark, list(CLEAN), text_fn.clean_text) == list(CLEAN.values())


def test_words_and_strip_follow_python(spark):
    rnd = random.Random(1)
    alphabet = "aB é  \x1c\x85\t\nßİ　​_½"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    assert one(spark, texts, text_fn.words) == [t.lower().split() for t in texts]
    assert one(spark, texts, text_fn.strip) == [t.strip() for t in texts]
    assert one(spark, texts, text_fn.is_blank) == [t.strip() == "" for t in texts]


def test_word_class_follows_python(spark):
    # only characters whose kind is the same in old and new Unicode versions
    old = unicodedata.ucd_3_2_0.category
    chars = [c for c in map(chr, range(0x20, 0x2FFF)) if c not in "<>\"'" and old(c) == unicodedata.category(c) != "Cn"]
    spaced = one(spark, ["x" + c + "x" for c in chars], text_fn.clean_text)
    changed = {c for c, out in zip(chars, spaced) if out == "x x"}
    assert changed == {c for c in chars if not re.match(r"[\w.,!?'\"]", c)}


def test_labels_and_previews(spark):
    assert one(spark, ["x" * 20, "x" * 21, None], text_fn.shorten) == ["x" * 20, "x" * 20 + "...", None]
    assert one(spark, ["ab", "y" * 200], text_fn.preview) == ["ab...", "y" * 150 + "..."]


DATES = {
    "2020-05-17": ("2020-05-17", 2020),
    "2020-05": ("2020-05-01", 2020),
    "2020": ("2020-01-01", 2020),
    "2020-5": (None, None),
    "2020-13": (None, 2020),
    "2020-02-30": (None, None),
    "20200": (None, None),
    "2020-05-17T10:00": (None, None),
    " 2020 ": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_dates(spark):
    days = one(spark, list(DATES), published_date)
    assert [d and d.isoformat() for d in days] == [d for d, _ in DATES.values()]
    assert one(spark, list(DATES), publication_year) == [y for _, y in DATES.values()]


def test_first_element(spark):
    got = one(spark, [["a", "b"], [], None], lambda c: first_or(c, "none"), "array<string>")
    assert got == ["a", "none", "none"]
