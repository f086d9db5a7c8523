"""Which filters remove what, in every order of applying them.

Five filters look at a whole text. Four need the text alone: few words (A), few different words (B), many capitals (C),
a mark of ``#$%&*|`` (D). The fifth (E) asks whether a smaller ``doc_id`` has the same text. What a document fails is a
mask of five bits, and everything the audit reports, for all 120 orders, follows from how many documents of each part
have each mask; so the table is reduced to masks first.

E works on radix tries. Texts are dealt out by ranges of adaptive prefixes: cuts between texts of a sample, each as long
as it must be to tell its neighbours apart. A range's whole texts go into a compressed trie, whose terminals hold the
smallest id; afterwards each document is a duplicate if its id is larger than that of its terminal. Texts come to it in
their order, so a trie that has grown to ``trie_bytes`` is read off and emptied before the next different text, and
ranges may be larger than memory. Before that, each task puts its own texts into such a trie: of equal texts only the
rows with the task's smallest id go on to the ranges, the others are duplicates already. So copies in any number reach a
range at most once a task, or once for each ``trie_bytes`` that a task reads.

Defined results: a NULL text counts as empty; NULL and empty texts are equal. A row without ``doc_id`` is no duplicate,
makes none, and has no label. Rows that repeat a ``doc_id`` are not duplicates of each other; each counts. A document
has a label if any row of ``labels`` says so. NULL and empty ``lang`` are one part. No document, no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.llm.radix import RadixTrie, cut_points, range_of
from shelf.scratch import materialize

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: fixed values
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: bytes of text that a task's own trie takes before it is emptied, and that a range is meant to hold
TRIE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: texts looked at for each range, to set its ends
SAMPLES = 24


def mask_of(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # bytes: at the six ASCII spaces
    n = len(words)
    return (
        (n < 200)
        | (100 * len(set(words)) < 50 * n) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 3 * n_chars) << 2
        | (len(raw.translate(None, MARKS)) < len(raw)) << 3
    )


_FOUND = "doc_id long, part string, mask int, n long"
_OPEN = f"{_FOUND}, text binary, cell int"


def masks(documents: DataFrame, trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, part, mask, n): what each document fails; ``n`` equal rows are one."""
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    cuts = cut_points(texts, "text", range_bytes, SAMPLES)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows = RadixTrie(), []

        def emptied() -> pa.RecordBatch:
            found = {}
            for doc_id, part, mask, place in rows:
                least = trie.least[place]
                repeated = doc_id is not None and least < doc_id
                key = doc_id, part, mask | REPEATED if repeated else mask, None if repeated or doc_id is None else place
                found[key] = found.get(key, 0) + 1
            keys = list(found)
            held = {place: trie.text(place) for *_, place in keys if place is not None}
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([k[2] for k in keys], pa.int32()),
                    pa.array(found.values(), pa.int64()),
                    pa.array([held.get(k[3]) for k in keys], pa.binary()),
                    pa.array([None if k[3] is None else range_of(held[k[3]], cuts) for k in keys], pa.int32()),
                ],
                names=["doc_id", "part", "mask", "n", "text", "cell"],
            )

        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())
            for doc_id, part, raw in zip(*columns, strict=True):
                rows.append((doc_id, part, mask_of(raw, len(raw.decode("utf-8", "replace"))), trie.insert(raw, doc_id)))
                if trie.bytes >= trie_bytes:
                    yield emptied()
                    trie, rows = RadixTrie(), []
        if rows:
            yield emptied()

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, trie, rows = None, None, RadixTrie(), []

        def judged() -> pa.RecordBatch:
            masks_ = [mask | REPEATED if trie.least[place] < doc_id else mask for doc_id, _, mask, _, place in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array(masks_, pa.int32()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                names=["doc_id", "part", "mask", "n"],
            )

        for batch in batches:
            for doc_id, part, mask, n, raw, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != now or (trie.bytes >= trie_bytes and raw != last):
                    if rows:
                        yield judged()
                    trie, rows = RadixTrie(), []
                now, last = cell, raw
                rows.append((doc_id, part, mask, n, trie.insert(raw, doc_id)))
        if rows:
            yield judged()

    found = materialize(texts.mapInArrow(first_pass, _OPEN), "open")
    in_ranges = found.where(F.col("cell").isNotNull()).repartition("cell").sortWithinPartitions("cell", "text")
    settled = found.where(F.col("cell").isNull()).select("doc_id", "part", "mask", "n")
    return settled.union(in_ranges.mapInArrow(second_pass, _FOUND))


def _orders() -> Column:
    """(filter_order, step, own bit, bits before it) of every step of every order: 600 fixed rows."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append(("".join(order), step, bit, before))
            before |= bit
    kind = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    return F.from_json(F.lit(pd.DataFrame(steps, columns=["filter_order", "step", "bit", "before"]).to_json(orient="records")), kind)


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from (part, mask, n, good, toxic)."""
    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    steps = of_part.select("part", "m", F.explode(_orders()).alias("s")).select("part", "m", "s.*")

    def total(field: str, met) -> Column:
        return F.aggregate(F.filter("m", met), F.lit(0).cast("long"), lambda so_far, x: so_far + x[field])

    bit, before = F.col("bit"), F.col("before")
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    reached = lambda x: x["mask"].bitwiseAND(before) == 0
    removed = lambda x: fails(x) & reached(x)
    # of 120 orders each of k failed filters comes first in 120 / k
    share = lambda so_far, x: so_far + x["n"] * F.expr("120") / F.bit_count(x["mask"])
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda x: reached(x) & ~fails(x)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda x: fails(x) & ~reached(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate(F.filter("m", fails), F.lit(0).cast("double"), share).cast("long").alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    found = masks(documents, **how).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    labelled = found.join(said, "doc_id", "left")
    counts = labelled.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    return report(counts)
