import random

import pytest

from conftest import plan_of
from models import titles_left
from shelf.operators import titles
from shelf.operators.titles import title_dedup


def kept(spark, groups):
    rows = [(g, k, t) for g, titles in groups.items() for k, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "author string, ord long, title string")
    out = {g: [] for g in groups}
    for r in title_dedup(df).collect():
        out[r.author].append(r.ord)
    return {g: sorted(v) for g, v in out.items()}


FIXED = {
    "series": (["Dune", "Dune Messiah", "dune "], [0]),
    "short": (["It", "It Ends", "it"], [0, 1]),
    "longer first": (["Emma Illustrated", "Emma"], [1]),
    "four chars": (["ab cd ef", "cd", "b cd"], [1, 2]),
    "blank": (["", " ", "Tide"], [0, 2]),
    "inside a word": (["The Dunes", "dune"], [1]),
    "other author": (["Dune"], [0]),
    None: (["Dune", "Dunes"], [0]),
}


def test_fixed_cases(spark):
    got = kept(spark, {g: titles for g, (titles, _) in FIXED.items()})
    assert got == {g: want for g, (_, want) in FIXED.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_sequential_model(spark, seed):
    rnd = random.Random(seed)
    groups = {}
    for g in range(120):
        letters = "ab " if g % 2 else "abcé "
        groups[f"g{g}"] = [
            "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 15))
        ]
    assert kept(spark, groups) == {g: titles_left(t) for g, t in groups.items()}


def test_one_group_and_one_title_hold_most_rows(spark):
    titles = ["The Tide"] * 3000 + [f"The Tide, volume {k}" for k in range(500)] + ["Tide"]
    got = kept(spark, {"big": titles, "small": ["Tide", "A Tide"]})
    assert got == {"big": [3500], "small": [0]}


def test_titles_are_never_paired_off(spark):
    df = spark.createDataFrame([("a", 1, "Dune"), ("a", 2, "Dune Messiah")], "author string, ord long, title string")
    text = plan_of(title_dedup(df))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SortMergeJoin" in text


def test_nested_titles_of_all_lengths_stay_few_rows(spark, monkeypatch):
    """2,000 titles of one opening: rows as many as characters at most, not as titles times lengths at every position."""
    opening = "".join(random.Random(4).choice("abcdefgh ") for _ in range(2100)).strip()
    titles_ = [opening[:n].strip() for n in range(4, 2004)]
    random.Random(5).shuffle(titles_)
    seen = []
    real = titles._holding

    def counted(searched, filed, at_start):
        seen.append((at_start, searched.count(), filed.count()))
        return real(searched, filed, at_start)

    monkeypatch.setattr(titles, "_holding", counted)
    others = ["x" + opening[40:60], "zz " + opening[:4], "unlike all of them"]
    want = {"g": titles_left(titles_ + others)}
    assert kept(spark, {"g": titles_ + others}) == want
    # all of the chain is settled at its beginnings; what is searched at every position are its shortest and the others
    assert len(seen) == 2 and seen[1][0] is False and seen[1][1] <= 4 and seen[1][2] <= 4


def test_titles_that_part_after_a_common_opening(spark):
    rnd = random.Random(8)
    opening = "the collected tales of"
    group = [opening + " " + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    group += [f"{a} and {b}" for a, b in zip(group[::3], group[1::3])]
    assert kept(spark, {"g": group}) == {"g": titles_left(group)}
