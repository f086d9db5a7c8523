"""Title rule: a title goes when a shorter one of the same author is inside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.functions.text import normal_title
from shelf.scratch import materialize, spread

# fixed value: titles up to this length only remove their equals
SHORT_TITLE = 3


def distinct_titles(df: DataFrame, group: str, order: str, title: str) -> DataFrame:
    """(tid, g, t, ord, len): every normalised title of a group once, with its first place.

    A ``min`` combines before the shuffle, so a title that a third of all rows carry is
    one row per task by then. ``tid`` numbers the rows and is fixed by the write.
    """
    titles = (
        df.groupBy(F.col(group).alias("g"), normal_title(title).alias("t"))
        .agg(F.min(order).alias("ord"))
        .withColumn("len", F.length("t"))
        .withColumn("tid", F.monotonically_increasing_id())
    )
    return spread(materialize(titles, "titles"))


def _digest(text):
    # never NULL, or a join on it would test it for that, and compute it once more to do so
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (fixed values: the constants of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(powers: list[int], heads: bool, at_start: bool = False):
    """Hash every piece of a power-of-two length of every title in a batch, or the heads only.

    ``at_start`` leaves out all pieces but a title's first of each length.

    The batch is one array of characters. The hash of 2p characters comes from those of
    its two halves, so each length costs one pass over the array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, gh = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = batch.column(2).to_pylist()
            lens = np.array([len(t) for t in texts], dtype="int64")
            hashes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="uint32").astype("uint64")
            owner = np.repeat(np.arange(len(texts)), lens)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
            size = lens[owner]
            hashes, p = _mix(hashes + np.uint64(1)), 1
            while len(hashes) and p <= powers[-1]:
                if p in powers:
                    n = len(hashes)
                    if heads:
                        take = np.flatnonzero((pos[:n] == 0) & (size[:n] >= p) & (size[:n] < 2 * p))
                    else:
                        take = np.flatnonzero((pos[:n] + p <= size[:n]) & (p < size[:n]) & (not at_start or pos[:n] == 0))
                    salt = gh[owner[take]].astype("uint64") * np.uint64(2) + np.uint64(p)
                    key = _mix(hashes[take] ^ _mix(salt)).view("int64")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tid[owner[take]]), pa.array(pos[take] + 1, pa.int32()),
                         pa.array(size[take].astype("int32")), pa.array(key)],
                        names=["tid", "pos", "len", "key"])
                if at_start:  # the halves of a longer beginning are whole pieces side by side
                    n = len(hashes)
                    left = np.flatnonzero((pos[:n] % (2 * p) == 0) & (pos[:n] + 2 * p <= size[:n]))
                    hashes = _mix(hashes[left] * np.uint64(3) + hashes[left + 1])
                    owner, pos, size = owner[left], pos[left], size[left]
                else:
                    hashes = _mix(hashes[:-p] * np.uint64(3) + hashes[p:])
                p *= 2

    return run


def _holding(searched: DataFrame, filed: DataFrame, at_start: bool) -> DataFrame:
    """(g, ord) of the ``searched`` titles that have another, shorter one of ``filed`` inside.

    ``at_start`` looks for beginnings only; without it, beginnings are found as well.

    1. a title *a* of length L is filed under its head, its first p characters, p being
       the largest power of two not above L. A head keeps only the set of lengths filed
       there, fewer than p numbers.
    2. a title *b* looks up each of its pieces of a power-of-two length, by hash. A hit
       says "a title with this head and one of these lengths could start here".
    3. the pieces of those lengths are looked up among the titles themselves.
    """
    levels = filed.select(F.length(F.bin("len")).alias("bits")).distinct().collect()
    if not levels:
        return searched.select("g", "ord").where(F.lit(False))
    powers = sorted(1 << (r["bits"] - 1) for r in levels)
    schema = "tid long, pos int, len int, key long"

    def text(titles: DataFrame) -> DataFrame:
        return titles.select("tid", F.xxhash64("g").alias("gh"), "t")

    heads = text(filed).mapInArrow(_pieces(powers, True), schema).groupBy("key").agg(F.collect_set("len").alias("lens"))

    def fits(cut, own):
        return (cut < own) & (F.col("pos") + cut <= own + 1)

    starts = (
        text(searched).mapInArrow(_pieces(powers, False, at_start), schema)
        # a merge join, because the pieces are far more than the planner expects of them
        # and must not be broadcast
        .join(heads.hint("merge"), "key")
        .select("tid", "pos", F.explode(F.filter("lens", lambda cut: fits(cut, F.col("len")))).alias("cut"))
    )
    # pieces travel as digests, so a row is small however long the piece
    cuts = starts.join(searched, "tid").select("g", "ord", _digest(F.expr("substring(t, pos, cut)")).alias("d")).distinct()
    c, a = cuts.alias("c"), filed.select("g", _digest(F.col("t")).alias("d")).alias("a")
    return (
        c.join(a, F.col("c.g").eqNullSafe(F.col("a.g")) & (F.col("c.d") == F.col("a.d")), "left_semi")
        .select("g", "ord")
        .distinct()
    )


def containing_titles(titles: DataFrame, min_length: int = SHORT_TITLE + 1) -> DataFrame:
    """(g, ord) of the titles that have another, shorter one of their group inside.

    ``titles`` holds each (g, t) once. Containment is by character, so words cannot be
    the blocking key; ``_holding`` says what is looked up instead.

    A chain of nested titles, each the beginning of the next, need not be known as a
    whole: whatever has one of them inside has the shortest of them inside. So titles that
    begin with another one are found first, at one position per title and so in rows as many as the
    titles have characters, and only the others, no two of them nested at their start, are
    filed for the search at all positions.

    Both lookups meet at most one row per key, so a frequent key is a skewed join side, not
    a product. In the second step a hit becomes as many rows as different lengths of titles are filed
    under its head and fit; these titles part after their common opening.
    """
    long = titles.where(F.col("len") >= min_length)
    nested = materialize(_holding(long, long, at_start=True), "nested")
    shortest = materialize(_without(long, nested), "shortest")
    return nested.union(_holding(shortest, shortest, at_start=False))


def _without(titles: DataFrame, gone: DataFrame) -> DataFrame:
    t, x = titles.alias("t"), gone.alias("x")
    return t.join(x, F.col("t.g").eqNullSafe(F.col("x.g")) & (F.col("t.ord") == F.col("x.ord")), "left_anti")


def title_dedup(df: DataFrame, group: str = "author", order: str = "ord", title: str = "title") -> DataFrame:
    """Keep a row unless its group has a shorter title inside its own, or an equal one earlier.

    Titles compare stripped and in lower case. Titles of up to three characters remove
    only their equals. ``order`` must be unique within a group. The outcome does not
    depend on processing order, so no loop is needed: whatever removes a title is, or
    contains, a title that nothing removes.
    """
    titles = distinct_titles(df, group, order, title)
    gone = containing_titles(titles)
    keep = _without(titles, gone).select(F.col("g").alias("_g"), F.col("ord").alias("_ord"))
    return df.join(
        keep, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_ord")), "left_semi"
    )
