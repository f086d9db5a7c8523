"""Substring deduplication by hashing lines or paragraphs, and pieces of them.

A text is cut into units: lines, or paragraphs (runs of lines between blank ones). A unit is normalised (lower case,
white space to single blanks) and digested. Digests meet in one global grouping that finds the least rank of each; a
rank is (``doc_id``, offset). What is not the earliest of its digest is repeated; what remains keeps its spelling and
order, and every cut is reported with offsets into the original text.

Texts are cut a part (500 rows) at a time, and of a part only the head of a digest, its least rank there, goes to the
grouping. So every unit is shuffled once at most, and a digest that is everywhere brings one row a part. What else a part
has of the digest asks its head for the first rank, in a join by digest and head, whose groups are no larger than a part.

A passage that was copied into the middle of a line is no unit of its own. So a unit's pieces are digested like units. A
piece ends behind a word whose hash is the least among its ``REACH`` neighbours on either side, so inside a passage
pieces end at the same words whatever stands around it, but for ``REACH`` words at its edges; they have about nine words.

Repeated pieces are cut where they follow each other, over the ends of lines too, for ``min_words`` words or more. So a
sentence or a line that many texts have by the way stays, and a passage that is a little longer goes.

Defined results: NULL and empty texts have no units and stay as they are; blank units are never cut and end no row of
pieces. Where a repeated unit goes, its pieces are not reported; a unit whose pieces all go, goes. Rows without
``doc_id`` have no rank: they stay whole and remove nothing. Rows that repeat a ``doc_id`` are one document as far as ranks
go: equal units at equal offsets are the same occurrence, so none of them is removed because of the other; a differing
text is cut by its own units. A text may end up empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm.common import in_parts, per_worker
from shelf.scratch import materialize, temporary

SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[^\S\n]*\n)+")}
WORD = re.compile(r"\S+\s*")
#: neighbours on either side that a word's hash must undercut to end a piece
REACH = 4

SPAN = "struct<start:int,end:int,first_doc_id:bigint,first_start:int>"


def spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every unit, in code points, without its separator."""
    at = 0
    for gap in SEPARATORS[unit].finditer(text):
        yield at, gap.start()
        at = gap.end()
    yield at, len(text)


class WordHashes(dict):
    """The first 32 bits of each word's MD5, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.md5(word.encode("utf-8", "replace")).digest()[:4], "big")
        return found


def word_starts(text: str, start: int, words: list[str]) -> list[int]:
    """Where each of a unit's words begins in the text."""
    first = text.find(words[0], start)
    lengths = list(map(len, words))
    ends = list(accumulate(lengths, lambda so_far, n: so_far + n + 1, initial=first))
    if text.startswith(" ".join(words), first):  # one blank between words
        return ends[:-1]
    return [m.start() for m in islice(WORD.finditer(text, first), len(words))]


def ends_of_pieces(sizes: list[int], words: list[str], hashes: WordHashes) -> np.ndarray:
    """True for each of the words, those of all units one after the other, that ends a piece."""
    h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
    size = np.array(sizes)
    starts = np.repeat(size.cumsum() - size, size)
    place = np.arange(len(h)) - starts
    ends = (place >= REACH) & (place < np.repeat(size, size) - REACH)
    at = np.flatnonzero(ends)
    for step in range(1, REACH + 1):
        at = at[(h[at - step] > h[at]) & (h[at] <= h[at + step])]
    ends[:] = False
    ends[at] = True
    ends[size.cumsum()[size > 0] - 1] = True
    return ends


def pieces(text: str, units: list[tuple[int, int]], hashes: WordHashes) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of every unit that has words and of its pieces, each span once.

    White space behind a piece belongs to it, and what stands before a unit's first word to its first piece.
    """
    own = [text[a:b].split() for a, b in units]
    lower = [text[a:b].lower().split() for a, b in units]
    flat = [w for words in lower for w in words]
    if not flat:
        return
    ends, at = ends_of_pieces(list(map(len, lower)), flat, hashes), 0
    for (start, end), words, small in zip(units, own, lower, strict=True):
        if not words:
            continue
        yield start, end, small
        cuts = (np.flatnonzero(ends[at : at + len(small)]) + 1).tolist()
        at += len(small)
        if len(cuts) > 1:
            begins = word_starts(text, start, words)
            edges = [start, *(begins[k] for k in cuts[:-1]), end]
            for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
                yield edges[k], edges[k + 1], small[a:b]


def heads_of(high: np.ndarray, low: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every row of a part the place of the one row that has the least rank of its digest there."""
    heads, order = np.arange(len(high)), np.argsort(high, kind="stable")
    same = high[order][1:] == high[order][:-1]
    shared = np.zeros(len(high), bool)
    shared[1:] |= same
    shared[:-1] |= same
    at = order[shared]
    at = at[np.lexsort((starts[at], doc_ids[at], low[at], high[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (high[at][1:] != high[at][:-1]) | (low[at][1:] != low[at][:-1])
    heads[at] = at[new][new.cumsum() - 1]
    return heads


def repeated_units(documents: DataFrame, unit: str = "line") -> DataFrame:
    """(doc_id, version, start, end, first_doc_id, first_start) of every unit and piece that repeats an earlier one.

    ``version`` is a hash of the text that the offsets count in.
    """

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = per_worker(("word hashes",), WordHashes)
        for frame in in_parts(frames):
            names, versions, starts, ends, digests = [], [], [], [], []
            for doc_id, version, text in zip(frame["doc_id"], frame["version"], frame["text"], strict=True):
                before = len(starts)
                for a, b, words in pieces(text, list(spans(text, unit)), hashes):
                    starts.append(a)
                    ends.append(b)
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))
                names += [doc_id] * (len(starts) - before)
                versions += [version] * (len(starts) - before)
            high, low = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
            ids, begins = np.array(names, np.int64), np.array(starts, np.int32)
            heads = heads_of(high, low, ids, begins)
            first = heads == np.arange(len(heads))
            copied = np.zeros(len(heads), bool)
            copied[heads[~first]] = True
            yield pd.DataFrame({
                "doc_id": ids, "version": np.array(versions, np.int64), "start": begins, "end": np.array(ends, np.int32),
                "high": high, "low": low, "head_doc_id": pd.arrays.IntegerArray(ids[heads], first),
                "head_start": pd.arrays.IntegerArray(begins[heads], first), "copied": copied,
            })

    every = (
        documents.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
        .mapInPandas(
            units,
            "doc_id long, version long, start int, end int, high long, low long, "
            "head_doc_id long, head_start int, copied boolean",
        )
    )
    # written once: both the grouping and the join below read it, and cutting texts is what costs most
    every = materialize(every, "units")
    span, first = ("doc_id", "version", "start", "end"), ("first_doc_id", "first_start")
    # no structs here: Spark would put them into the exchange, beside the columns that they are made of
    ranked = Window.partitionBy("high", "low").orderBy("doc_id", "start").rowsBetween(Window.unboundedPreceding, 0)
    repeats = (F.col("doc_id") != F.col("first_doc_id")) | (F.col("start") != F.col("first_start"))
    heads = every.where("head_doc_id is null").select(
        *span, "high", "low", "copied",
        F.first("doc_id").over(ranked).alias("first_doc_id"), F.first("start").over(ranked).alias("first_start"),
    )
    heads = materialize(heads.where(repeats | F.col("copied")), "heads")
    # rows that repeat a doc_id may be heads of the same rank in several parts
    head = (F.col("doc_id").alias("head_doc_id"), F.col("start").alias("head_start"))
    asked = heads.where("copied").select("high", "low", *head, *first).distinct()
    others = every.where("head_doc_id is not null").join(asked, ["high", "low", "head_doc_id", "head_start"])
    return heads.select(*span, *first).union(others.select(*span, *first)).where(repeats)


def cut(text: str, gone: set[tuple[int, int]], unit: str, min_words: int) -> tuple[str, set[tuple[int, int]]]:
    """The text without those of the repeated spans ``gone`` that go, and these spans.

    Spans follow each other if nothing but white space is between them. A kept unit follows the separator that was before
    it; white space at the end of a cut unit goes.
    """
    whole: list[tuple[int, int]] = []  # without the pieces of units that are there themselves
    for a, b in sorted(gone, key=lambda x: (x[0], -x[1])):
        if not whole or a >= whole[-1][1]:
            whole.append((a, b))
    out, row, words = set(), [], 0
    for a, b in whole:
        if row and text[row[-1][1] : a].strip():
            out.update(row if words >= min_words else ())
            row, words = [], 0
        row.append((a, b))
        words += len(text[a:b].split())
    out.update(row if words >= min_words else ())
    if not out:
        return text, out
    ordered, k = sorted(out), 0
    parts, before = [], 0
    for start, end in spans(text, unit):
        left, at = [], start
        touched = False
        while k < len(ordered) and ordered[k][0] < max(end, start + 1) and ordered[k][0] >= start:
            left.append(text[at : ordered[k][0]])
            at, touched, k = ordered[k][1], True, k + 1
        line = "".join([*left, text[at:end]])
        if not touched or line.strip():
            parts += [text[before:start]] * bool(parts) + [line.rstrip() if touched else line]
        before = end
    return "".join(parts), out


def remove_repeats(documents: DataFrame, unit: str = "line", min_words: int = 16) -> DataFrame:
    """The documents, with ``text`` cut and a column ``removed`` appended; other columns pass through.

    ``removed`` lists the spans that went, in order: (start, end, first_doc_id, first_start), offsets into the old text
    and where the earliest occurrence is. A column of the input that is called ``removed`` is replaced.
    """
    with temporary(documents.sparkSession):  # the units go before the texts are moved
        repeats = materialize(repeated_units(documents, unit), "repeats", lasting=True)
    found = (
        repeats.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_doc_id", "first_start"))).alias("__found"))
    )

    @F.pandas_udf(f"text string, removed array<{SPAN}>")
    def rest(text: pd.Series, rows: pd.Series) -> pd.DataFrame:
        texts, removed = [], []
        for t, repeats in zip(text, rows, strict=True):
            spans_ = {(r["start"], r["end"]): r for r in ([] if repeats is None else repeats)}
            kept, gone = cut(t, set(spans_), unit, min_words) if spans_ and t is not None else (t, ())
            texts.append(kept)
            removed.append([spans_[x] for x in sorted(gone)])
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "removed": pd.Series(removed, dtype=object)})

    match = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__version"))
    kept = [c for c in documents.columns if c != "removed"]
    done = documents.join(found, match, "left").withColumn("__rest", rest("text", "__found"))
    return done.select(*(F.col("__rest.text").alias(c) if c == "text" else F.col(c) for c in kept), F.col("__rest.removed").alias("removed"))
