"""The trie of conversation prefixes, by vertical bitmaps.

A node of depth d is one sequence of d first turns; its members are the conversations that begin with it. A shard is a
run of conversations in the order of their ids, a row each. It indexes (position, turn) to a bitset of rows, and a
depth-first walk intersects a node's bitset with the postings of the next position: each non-empty intersection is a
child, its bits count its members, its lowest bit is its smallest member, and the rows that have no further turn are its
end list. Nodes of different shards are the same node if their prefixes are equal; a prefix is named by the exclusive or
of two 64-bit hashes of each (position, turn) in it, so its name can be carried on from any point.

Long conversations are cut into chunks of turns. A chunk knows the depth and the name of the prefix before it, so a
shard may hold any chunk, and neither a conversation nor a common prefix has to be in one task as a whole.

Sums over subtrees need no walk over the merged trie. Each node is owned by its smallest member, and a conversation owns
the end of its path, from some depth on. So a leaf counts once, for its owner, in all nodes of the owner's path, and
``(members - 1) * bytes`` summed over a subtree is, over its members, the bytes of those turns that a member does not
own. A second walk adds both up by shard.

Defined results: rows without ``conv_id`` take part in nothing. NULL role or text counts as empty. Turns are ordered by
``turn``, NULL first; rows of one turn, repeated ones included, all count and follow each other in the order of their
hashes. No conversation, no node; else the root (depth 0) is there. Columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.scratch import materialize

#: turns of a chunk
CHUNK = 64
#: rows of a shard at most
SHARD = 4096


class Trie(NamedTuple):
    """``nodes``: a row each, named by (conv_id, depth) and, inside, by (k1, k2). ``ends``: (k1, k2, first, ends), the end
    lists in parts; a node's parts in the order of ``first`` make up its whole list, ascending."""

    nodes: DataFrame
    ends: DataFrame


def chunked(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, turns): the turns of each conversation in order, ``size`` to a chunk, as hashes and byte counts.

    Turns are sorted over all tasks at once, so those of one conversation may lie in several, and are numbered from
    where each task's part of it begins.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("d1"),
        F.xxhash64(text, role).alias("d2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the task and, in its lower 33 bits, of the row in it
    placed = placed.select("conv_id", "d1", "d2", "bytes", F.monotonically_increasing_id().alias("at"))
    placed = materialize(placed, "turns").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.col("begin") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    runs = runs.select("conv_id", "part", zero.alias("zero"))
    chunk = F.floor((F.col("at") - F.col("zero")) / size).alias("chunk")
    gathered = F.sort_array(F.collect_list(F.struct("at", "d1", "d2", "bytes")))
    bare = F.transform(gathered, lambda x: F.struct(x["d1"].alias("d1"), x["d2"].alias("d2"), x["bytes"].alias("bytes")))
    return placed.join(runs, ["conv_id", "part"]).groupBy("conv_id", chunk).agg(bare.alias("turns"))


def with_head_of(chunks: DataFrame, other: Column, taken: Column, most: int) -> DataFrame:
    """Every conversation with the first ``taken`` turns of the conversation ``other`` for its own first ones.

    Both are columns of ``conv_id``, and ``taken`` is ``most`` at most, which a chunk must hold. A conversation that has
    fewer turns lends all, one that does not exist none.
    """
    if most > CHUNK:
        raise ValueError(f"a head must fit a chunk of {CHUNK} turns")
    chunks = materialize(chunks, "chunks")
    starts = chunks.where("chunk = 0")
    heads = starts.select(F.col("conv_id").alias("lender"), F.slice("turns", 1, most).alias("head"))
    wanted = starts.select("conv_id", "turns", other.alias("lender"), taken.cast("int").alias("taken"))
    own = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    none = F.slice("turns", 1, 0)
    first = wanted.join(heads, "lender", "left").select(
        "conv_id",
        F.lit(0).cast("long").alias("chunk"),
        F.concat(F.slice(F.coalesce("head", none), 1, F.col("taken")), own).alias("turns"),
    )
    return first.union(chunks.where("chunk > 0").select("conv_id", "chunk", "turns"))


def _paths(chunks: DataFrame) -> DataFrame:
    """Chunks with the depth and the prefix's name before them, each turn by its name at its position."""
    in_order = Window.partitionBy("conv_id").orderBy("chunk")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    deep = chunks.withColumn("depth", F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0)))

    def named(first: str, second: str, seed: int) -> Column:
        return F.transform("turns", lambda x, i: F.xxhash64(F.lit(seed), F.col("depth") + i + 1, x[first], x[second]))

    deep = deep.select(
        "conv_id", "chunk", "depth",
        named("d1", "d2", 1).alias("a1"), named("d2", "d1", 2).alias("a2"), F.col("turns.bytes").alias("bytes"),
        F.lead("chunk").over(in_order).isNull().alias("last"),
    )

    def carried(names: str) -> Column:
        own = F.aggregate(names, F.lit(0).cast("long"), lambda so_far, x: so_far.bitwiseXOR(x))
        return F.coalesce(F.bit_xor(own).over(before), F.lit(0))

    return deep.select("*", carried("a1").alias("k1"), carried("a2").alias("k2"))


class _Shard:
    """Rows (chunks of conversations, in the order of their ids) and the postings of their turns."""

    def __init__(self, rows: pd.DataFrame):
        self.conv_id = rows["conv_id"].to_numpy()
        self.depth = rows["depth"].to_numpy()
        self.last = rows["last"].to_numpy()
        self.first = sum(1 << int(r) for r in np.flatnonzero(rows["chunk"].to_numpy() == 0))
        self.entry = list(zip(rows["k1"].tolist(), rows["k2"].tolist(), self.depth.tolist(), strict=True))
        self.size = np.fromiter(map(len, rows["a1"]), np.int64, len(rows))
        self.start = self.size.cumsum() - self.size
        flat = [np.concatenate([*map(np.asarray, rows[c]), np.zeros(0, np.int64)]).astype(np.int64) for c in ("a1", "a2", "bytes")]
        self.a1, self.a2, self.bytes = flat
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.position = np.arange(len(self.row)) - self.start[self.row] + self.depth[self.row] + 1
        order = np.lexsort((self.row, self.a2, self.a1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.a1[order]) != 0) | (np.diff(self.a2[order]) != 0)
        code = np.empty(len(order), np.int64)
        code[order] = new.cumsum() - 1
        self.code = code.tolist()
        self.postings = self._bitsets(code)
        self.reach = self._bitsets(np.unique(self.position, return_inverse=True)[1]) if len(order) else []
        self.reach = dict(zip(np.unique(self.position).tolist(), self.reach, strict=True))
        self.a = list(zip(self.a1.tolist(), self.a2.tolist(), self.bytes.tolist(), strict=True))

    def _bitsets(self, key: np.ndarray) -> list[int]:
        out = [0] * (int(key.max(initial=-1)) + 1)
        for k, row in zip(key.tolist(), self.row.tolist(), strict=True):
            out[k] |= 1 << row
        return out

    @staticmethod
    def rows(bits: int) -> list[int]:
        found = []
        while bits:
            low = bits & -bits
            found.append(low.bit_length() - 1)
            bits ^= low
        return found

    def walk(self) -> Iterator[tuple[int, tuple, tuple, int, int, int]]:
        """(members, name, parent's name, depth, bytes, members that go on) of every node that begins in the shard."""
        entries: dict[tuple, int] = {}
        for row, entry in enumerate(self.entry):
            entries[entry] = entries.get(entry, 0) | 1 << row
        # a prefix that earlier chunks end with is a node of theirs; only the root has no chunk before it
        stack = [(bits, (k1, k2), None, depth, 0) for (k1, k2, depth), bits in entries.items()]
        start, depths, code = self.start.tolist(), self.depth.tolist(), self.code
        while stack:
            members, name, parent, depth, size = stack.pop()
            on = members & self.reach.get(depth + 1, 0)
            if depth == 0:
                members &= self.first  # a conversation may come to its first turn in a later chunk
            if members and (parent is not None or depth == 0):
                yield members, name, parent or (0, 0), depth, size, on
            while on:
                row = (on & -on).bit_length() - 1
                at = start[row] + depth - depths[row]
                child = on & self.postings[code[at]]
                on ^= child
                a1, a2, bytes_ = self.a[at]
                stack.append((child, (name[0] ^ a1, name[1] ^ a2), name, depth + 1, bytes_))


def _by_shard(work: Callable[[pd.DataFrame], pd.DataFrame], shard: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), shard):
                yield work(frame.iloc[at : at + shard])

    return run


def _nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The shard's nodes, counted within the shard."""
    shard = _Shard(rows)
    over = sum(1 << int(r) for r in np.flatnonzero(shard.last))
    out = []
    for members, name, parent, depth, size, on in shard.walk():
        ends = shard.conv_id[shard.rows(members & over & ~on)]
        low = int(shard.conv_id[(members & -members).bit_length() - 1])
        out.append((*name, *parent, depth, size, low, members.bit_count(), ends))
    return pd.DataFrame(out, columns=["k1", "k2", "p1", "p2", "depth", "bytes", "conv_id", "n_convs", "ends"])


def _sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Leaves and bytes saved below each of the shard's nodes, as far as the shard's rows account for them."""
    shard = _Shard(rows)
    leaf = sum(1 << int(r) for r in np.flatnonzero(rows["leaf"].to_numpy()))
    shared = np.where(shard.position < rows["since"].to_numpy()[shard.row], shard.bytes, 0)
    run = np.concatenate([[0], shared.cumsum()])
    rest = rows["rest"].to_numpy()
    # what a row's conversation shares from each of its turns on
    left = (rest[shard.row] - (run[:-1] - run[shard.start[shard.row]])).tolist() if len(shard.row) else []
    start, depths, rest = shard.start.tolist(), shard.depth.tolist(), rest.tolist()
    out = []
    for members, name, _, depth, _, _ in shard.walk():
        mine = shard.rows(members)
        saved = sum(rest[r] if depth == 0 else left[start[r] + depth - depths[r] - 1] for r in mine)
        out.append((*name, (members & leaf).bit_count(), saved))
    return pd.DataFrame(out, columns=["k1", "k2", "n_leaves", "saved_tokens"])


def trie(chunks: DataFrame, shard: int = SHARD) -> Trie:
    """The nodes of the conversations in ``chunks`` (conv_id, chunk, turns), see ``Trie``.

    Columns of a node: conv_id, the smallest member; depth; parent_conv_id (the root has none); n_convs; n_children;
    n_leaves; saved_tokens, the bytes of turns that members of the subtree's nodes need not store again.
    """
    paths = materialize(_paths(chunks), "paths")
    # in the order of ids, so that parts of an end list follow each other without overlap
    in_order = paths.repartitionByRange("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk")
    schema = "k1 long, k2 long, p1 long, p2 long, depth long, bytes long, conv_id long, n_convs long, ends array<long>"
    local = materialize(in_order.mapInPandas(_by_shard(_nodes, shard), schema), "local")
    merged = local.groupBy("k1", "k2").agg(
        *(F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv_id")), F.sum("n_convs").alias("n_convs")
    )
    merged = materialize(merged, "merged")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    counted = merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = materialize(counted, "counted")

    deepest = F.max(F.struct("depth", "n_children"))["n_children"]
    owners = counted.groupBy("conv_id").agg(F.min("depth").alias("since"), (deepest == 0).alias("leaf"))
    owned = paths.join(owners, "conv_id", "left")
    owned = owned.withColumn("since", F.coalesce("since", F.lit(2**62)))  # owns nothing: shares all
    shared = F.aggregate(
        F.transform("bytes", lambda x, i: F.when(F.col("depth") + i + 1 < F.col("since"), x).otherwise(0)),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    onward = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    owned = owned.withColumns({"rest": F.sum(shared).over(onward), "leaf": F.coalesce(F.col("leaf"), F.lit(False))})
    sums = owned.mapInPandas(_by_shard(_sums, shard), "k1 long, k2 long, n_leaves long, saved_tokens long")
    sums = sums.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")))
    known = materialize(counted.join(sums, ["k1", "k2"]), "known")
    parents = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # a common prefix has many children, which this join may split over tasks
    inner = known.where("depth > 0").join(parents, ["p1", "p2"], "left")
    columns = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    ends = local.where(F.size("ends") > 0).select("k1", "k2", F.col("ends")[0].alias("first"), "ends")
    return Trie(inner.select(*columns).union(root.select(*columns)), ends)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of each node's whole end list, decimal and joined by commas.

    A digest takes its bytes in their order, so a node's parts pass one task, one part at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for frame in frames:
            out = []
            for k1, k2, ids in zip(frame["k1"].tolist(), frame["k2"].tolist(), frame["ends"], strict=True):
                text = ",".join(map(str, np.asarray(ids).tolist())).encode()
                if now != (k1, k2):
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (k1, k2), hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    ordered = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return ordered.mapInPandas(run, "k1 long, k2 long, ends_sha256 string")


def digested(found: Trie) -> DataFrame:
    """The nodes with the digests of their end lists instead of the lists; no end, the empty text's digest."""
    nodes = found.nodes.join(ends_digests(found.ends), ["k1", "k2"], "left").drop("k1", "k2")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
