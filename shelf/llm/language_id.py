"""Language identification by rank-order profiles.

A profile is a ranked list of the most frequent character n-grams, one to three letters, of lower-cased words with a
blank at both ends. A language's profile comes from all of its texts. A document's own profile is held against each
language's: every n-gram of the document adds how far out of place it is, the difference of its two ranks, or
``profile`` if the language's list lacks it. The language with the smallest sum is the prediction.

An n-gram is one 63-bit number, three slots of 21 bits: 0 for none, 1 for a blank, else code point + 1. Counting sorts
these numbers, a bounded piece of text at a time.

Defined results: ``und`` and score 0 if the text is NULL or has no letter, or if nothing was learned. Equal counts rank
by the n-gram's number, equal sums by the language's name. Rows without ``lang`` or with ``held_out`` unknown (no
``doc_id``) teach nothing; a document without ``doc_id`` is not held out. Repeated rows count as often as they are there.
Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.llm.common import in_parts, per_worker
from shelf.scratch import materialize

#: n-grams of a profile
PROFILE = 400
#: code points counted at a time
PIECE = 1 << 21
#: languages whose profiles go to every task: ``profile`` numbers of 8 bytes each
MOST_LANGUAGES = 20_000
BLANK = 1


def slots() -> np.ndarray:
    """The slot of each code point: its lower case + 1 for letters, the blank for all else."""
    points = map(chr, range(0x110000))
    lower = (c.lower() if c.isalpha() else "" for c in points)
    return np.fromiter((ord(c[0]) + 1 if c else BLANK for c in lower), np.int32, 0x110000)


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each code point, number of its text); every text begins with a blank, and one ends the last."""
    table = per_worker(("slots of code points",), slots)
    raw = " ".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "replace")
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    return table[np.frombuffer(raw, np.uint32)], np.append(owner, len(texts) - 1 if len(texts) else 0)


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each is there or the sum of its counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums


def gram_counts(texts: list[str | None], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), ordered by the first two; ``group`` numbers the texts' groups from 0."""
    letters, owner = _letters(texts)
    alphabet, small = np.unique(letters, return_inverse=True)
    small = small.astype(np.int64) + 1  # 0 is no letter; the blank is 1 if it is there, and it always is
    bits = int(len(alphabet)).bit_length()
    wide = 3 * bits + int(group.max(initial=0)).bit_length() <= 63
    group_of = group[owner].astype(np.int64)
    keys, counts = [], []
    for at in range(0, len(small), PIECE):
        end = min(at + PIECE, len(small))
        a = small[at:end]
        b, c = (np.append(small[at + k : end + k], np.full(max(end + k - len(small), 0), 1)) for k in (1, 2))
        head = group_of[at:end] << (3 * bits) if wide else np.zeros(len(a), np.int64)
        one = head + (a << 2 * bits)
        two = one + (b << bits)
        for kept, key in ((a != 1, one), ((a != 1) | (b != 1), two), (b != 1, two + c)):
            if wide:
                found = _tally(key[kept])
                keys.append(found[0])
                counts.append(found[1])
            else:  # too many letters and groups for one number: group by group
                for g in np.unique(group_of[at:end]):
                    found = _tally(key[kept & (group_of[at:end] == g)])
                    keys.append(np.stack([np.full(len(found[0]), g), found[0]], 1))
                    counts.append(found[1])
    if wide:
        key, count = _tally(np.concatenate(keys), np.concatenate(counts))
        of_group, gram = key >> (3 * bits), key & ((1 << 3 * bits) - 1)
    else:
        pairs, place = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        count = np.bincount(place.ravel(), np.concatenate(counts), len(pairs)).astype(np.int64)
        of_group, gram = pairs[:, 0], pairs[:, 1]
    alphabet = np.concatenate([[0], alphabet]).astype(np.int64)
    mask = (1 << bits) - 1
    whole = sum(alphabet[(gram >> (k * bits)) & mask] << (21 * k) for k in range(3))
    return of_group, whole, count


def ranked(group: np.ndarray, gram: np.ndarray, count: np.ndarray, profile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, rank) of each group's most frequent n-grams."""
    order = np.lexsort((gram, -count, group))
    group, gram = group[order], gram[order]
    first = np.searchsorted(group, group)
    rank = np.arange(len(group)) - first
    top = rank < profile
    return group[top], gram[top], rank[top]


def learn(texts: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profile of every language in ``texts`` (text, lang), from all of its texts."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in in_parts(frames, 250):
            names, group = np.unique(part["lang"].to_numpy(str), return_inverse=True)
            of, gram, count = gram_counts(part["text"].tolist(), group)
            for k, name in enumerate(names.tolist()):
                mine = of == k
                old = held.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                held[name] = _tally(np.concatenate([old[0], gram[mine]]), np.concatenate([old[1], count[mine]]))
            if sum(len(g) for g, _ in held.values()) > PIECE:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    def rows_of(held: dict) -> Iterator[pd.DataFrame]:
        for name, (gram, count) in held.items():
            yield pd.DataFrame({"lang": name, "gram": gram, "uses": count})

    counts = texts.select("text", "lang").mapInPandas(counted, "lang string, gram long, uses long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("uses").alias("uses"))
    # in two steps, so that no task holds all n-grams of a language
    best_first = [F.col("uses").desc(), F.col("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    near = sums.withColumn("near", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best_first))).where(F.col("near") <= profile)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)) - 1
    return near.withColumn("rank", rank).where(F.col("rank") < profile).select("lang", "gram", "rank")


def predict(documents: DataFrame, profiles: DataFrame, profile: int = PROFILE) -> DataFrame:
    """The other columns of ``documents`` (with ``text``), lang_pred and score; ``profiles`` as ``learn`` returns them.

    Score is 1 at no distance and 0 where none of the document's n-grams is in the profile. All profiles go to every
    task; there may be ``MOST_LANGUAGES`` of them at most.
    """
    spark = documents.sparkSession
    languages = profiles.select("lang").distinct().count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; profiles of {MOST_LANGUAGES} at most are sent to every task")
    lists = profiles.toPandas().sort_values(["lang", "gram"])
    known = [(name, x["gram"].to_numpy(np.int64), x["rank"].to_numpy(np.int64)) for name, x in lists.groupby("lang", sort=True)]
    sent = spark.sparkContext.broadcast(known)

    def judged(texts: list[str | None]) -> tuple[list[str], list[float]]:
        of, gram, rank = ranked(*gram_counts(texts, np.arange(len(texts))), profile)
        size = np.bincount(of, minlength=len(texts))
        best, name_of = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
        for k, (_, grams, ranks) in enumerate(sent.value):
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            off = np.where(grams[at] == gram, np.abs(ranks[at] - rank), profile)
            far = np.bincount(of, off, len(texts)).astype(np.int64)
            nearer = far < best
            best[nearer], name_of[nearer] = far[nearer], k
        said = (size > 0) & (name_of >= 0)
        names = [sent.value[k][0] if ok else "und" for k, ok in zip(name_of.tolist(), said.tolist(), strict=True)]
        score = np.where(said, 1 - np.where(said, best, 0) / (profile * np.maximum(size, 1)), 0.0)
        return names, score.tolist()

    others = documents.drop("text", "lang_pred", "score")
    names = [*others.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                said, score = judged(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(said, pa.string()), pa.array(score, pa.float64())], names)

    schema = T.StructType([*others.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.select("text", *others.columns).mapInArrow(run, schema)


def judge(documents: DataFrame, held_out: Column, profile: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; those with ``held_out`` teach nothing."""
    marked = documents.select("doc_id", "text", "lang", held_out.alias("held_out"))
    profiles = materialize(learn(marked.where("not held_out and lang is not null"), profile), "profiles")
    found = predict(marked.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), profiles, profile)
    return found.select("doc_id", "held_out", "lang_pred", "score")
