"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

A document's fingerprint has a bit set where over half of its shingle hashes have it set. Fingerprints that differ in
at most ``reach`` bits are linked; a document's component is everything reachable over links.

The table of pivot distances holds, for every distinct fingerprint, its Hamming distances to a fixed list of reference
fingerprints. By the triangle inequality two fingerprints within ``reach`` of each other differ by at most ``reach`` in
every column, so a pair with a larger difference in any column is discarded without looking at the fingerprints;
survivors are verified bit by bit. Which pairs meet at all is settled without loss: the 64 bits are cut into
``reach + 3`` blocks, a linked pair agrees in at least three of them, so every fingerprint is filed under each choice of
three blocks. A file with more than ``block`` members is dealt into blocks of members, and each pair of blocks is one
unit of work. A unit returns, for each of its rows, the least row it hangs together with, not its pairs.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked like any other. A text of fewer words
than a shingle is one shingle. Equal fingerprints need no link. Rows without ``doc_id`` get a fingerprint and the
component NULL, take part in nothing, and ``drop_near_copies`` keeps them. Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf.operators.components import components
from shelf.scratch import materialize, temporary

PIVOTS = 16
SHARED_BLOCKS = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = (size + 1).cumsum() - 1
    starts, last = ends - size, ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as an unsigned number: bits that over half of them have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # 64 bytes a hash at a time
        bits = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), 1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(shingle: int = 3):
    """A column function from text to fingerprint (a long that holds the 64 bits)."""

    @F.pandas_udf("long")
    def fingerprints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([majority(shingle_hashes(t, shingle)) for t in text], np.uint64).view(np.int64))

    return fingerprints


def pivots(count: int = PIVOTS, seed: int = 1) -> np.ndarray:
    """The reference fingerprints: random, the same everywhere."""
    return np.random.default_rng(seed).integers(0, 2**64, count, np.uint64, endpoint=False)


def pivot_distances(fingerprints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """A row of Hamming distances to the references for every fingerprint."""
    return np.bitwise_count(fingerprints.view(np.uint64)[:, None] ^ references).astype(np.int8)


def _blocks(reach: int) -> list[int]:
    """Masks of the blocks that the 64 bits are cut into."""
    cuts = np.linspace(0, 64, reach + SHARED_BLOCKS + 1).round().astype(int).tolist()
    return [(2**b - 2**a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _files(fp: Column, reach: int) -> Column:
    """The keys a fingerprint is filed under: number of the choice of blocks, and the bits in them."""
    chosen = [sum(c) for c in combinations(_blocks(reach), SHARED_BLOCKS)]
    return F.array(
        *(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for n, m in enumerate(chosen))
    )


def _hang_together(group: np.ndarray, fp: np.ndarray, table: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row linked to it, over links inside its group) for whole groups of adjacent rows.

    Rows of a group are ordered by their first pivot distance, so a row is only held against those that follow it
    within ``reach`` of that distance.
    """
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    label = np.arange(len(fp))
    left = np.arange(len(fp))
    for step in range(1, len(fp)):
        left = left[left + step < len(fp)]
        right = left + step
        near = (group[left] == group[right]) & (table[right, 0] - table[left, 0] <= reach)
        left = left[near]  # what is too far now is too far at every later step
        if not len(left):
            break
        open_ = left[label[left] != label[left + step]]  # not yet known to hang together
        kept = open_[np.abs(table[open_ + step] - table[open_]).max(1, initial=0) <= reach]
        apart = (fp[kept] ^ fp[kept + step]).view(np.uint64)  # of a negative number bitwise_count counts the absolute value
        kept = kept[np.bitwise_count(apart) <= reach]
        a, b = kept, kept + step
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]
    while not np.array_equal(label, label[label]):
        label = label[label]
    hung = label != np.arange(len(fp))
    return fp[hung], fp[label[hung]]


def links(fingerprints: DataFrame, reach: int = 3, block: int = 2048) -> DataFrame:
    """(a, b) for distinct fingerprints ``fp``: pairs whose graph has the components of all links within ``reach``."""
    files = fingerprints.select("fp", F.explode(_files(F.col("fp"), reach)).alias("file"))
    crowd = files.groupBy("file").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # a member meets every part of its file: unit (i, j) holds the parts i and j
    units = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least(F.col("part"), other).alias("i"), F.greatest(F.col("part"), other).alias("j")),
    )
    work = (
        files.join(crowd, "file")
        .select("file", "fp", F.ceil(F.col("members") / block).cast("int").alias("parts"))
        .select("file", "fp", "parts", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"))
        .select("file", "fp", F.explode(units).alias("unit"))
        .select(F.xxhash64("file", "unit").alias("unit_key"), "file", "unit", "fp")
        .repartition("unit_key")
        .sortWithinPartitions("unit_key", "file", "unit")
        .select("unit_key", F.col("file.choice").alias("choice"), F.col("file.bits").alias("bits"), "unit.i", "unit.j", "fp")
    )
    references = pivots()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["unit_key", "choice", "bits", "i", "j"]
        rest = None
        for frame in _with_last(frames):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or rest.empty:
                continue
            change = (rest[key].to_numpy()[1:] != rest[key].to_numpy()[:-1]).any(1)
            group = np.concatenate([[0], change.cumsum()])
            whole = len(rest) if frame is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                fp = rest["fp"].to_numpy()[:whole]
                a, b = _hang_together(group[:whole], fp, pivot_distances(fp, references), reach)
                yield pd.DataFrame({"a": a, "b": b})
            rest = rest.iloc[whole:]

    return work.mapInPandas(compare, "a long, b long").distinct()


def _with_last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def near_copies(documents: DataFrame, shingle: int = 3, reach: int = 3, block: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the component's name is its smallest ``doc_id``."""
    prints = materialize(documents.select("doc_id", fingerprint(shingle)(F.col("text")).alias("fp")), "fingerprints")
    classes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = components(links(classes.select("fp"), reach, block))
    named = classes.join(linked, classes.fp == linked.node, "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    first = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = named.join(first, "comp").select(F.col("fp").alias("class"), "component_id")
    return prints.join(of_class, F.col("fp") == F.col("class"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_copies(documents: DataFrame, shingle: int = 3, reach: int = 3) -> DataFrame:
    """The documents, with all their columns, without those of a component that has a smaller ``doc_id``.

    Of several rows with the kept ``doc_id`` all stay, and so do rows without ``doc_id``.
    """
    with temporary(documents.sparkSession):
        gone = near_copies(documents, shingle, reach).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
        gone = materialize(gone.distinct(), "gone", lasting=True)
    return documents.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
