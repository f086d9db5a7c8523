"""Compressed tries of whole texts, and the ranges of prefixes that deal texts out to them."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` has in common with ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    step = 16
    while low < high:  # doubling steps, then halves of the last one
        end = min(low + step, high)
        if a[low:end] == b[at + low : at + end]:
            low, step = end, 2 * step
            continue
        high = end - 1
        step = max((end - low) // 2, 1)
    return low


class RadixTrie:
    """A compressed trie of byte strings; a node's edge holds every byte since its parent.

    ``least`` has, for each node, the smallest id inserted there. Nodes are numbered, so inserting, finding and reading
    back go over arrays.
    """

    def __init__(self):
        self.edge: list[bytes] = [b""]
        self.parent: list[int] = [-1]
        self.children: list[dict[int, int] | None] = [None]
        self.least: list[int | None] = [None]
        self.bytes = 0

    def _add(self, edge: bytes, parent: int) -> int:
        self.edge.append(edge)
        self.parent.append(parent)
        self.children.append(None)
        self.least.append(None)
        if self.children[parent] is None:
            self.children[parent] = {}
        self.children[parent][edge[0]] = node = len(self.edge) - 1
        return node

    def insert(self, text: bytes, name: int | None) -> int:
        """The node of a text; NULL names leave its smallest id as it is."""
        node, at, size = 0, 0, len(text)
        while at < size:
            below = self.children[node]
            child = below.get(text[at]) if below else None
            if child is None:
                node = self._add(text[at:], node)
                self.bytes += size - at
                break
            edge = self.edge[child]
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            shared = shared_length(edge, text, at)
            fork = self._add(edge[:shared], node)  # takes the child's place below its parent
            self.edge[child], self.parent[child] = edge[shared:], fork
            self.children[fork] = {edge[shared]: child}
            node, at = fork, at + shared
        if name is not None and (self.least[node] is None or name < self.least[node]):
            self.least[node] = name
        self.bytes += 64
        return node

    def text(self, node: int) -> bytes:
        edges = []
        while node > 0:
            edges.append(self.edge[node])
            node = self.parent[node]
        return b"".join(reversed(edges))


def cut_points(texts: DataFrame, text: str, range_bytes: int, samples: int, length: int = 32, most: int = 1 << 14) -> list[bytes]:
    """Ascending prefixes at which the texts are cut into ranges of about ``range_bytes``, or into ``most`` larger ones.

    A sample is read by its first bytes. Where a whole range's worth of it begins alike, those texts alone are read
    again with prefixes four times as long, and so on, as far as the texts go. A cut is as short as it can be to part
    its neighbours. Cuts only decide where texts go; equal texts always go to the same range.
    """
    raw = F.col(text).cast("binary")
    size, rows = texts.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    ranges = min((size or 0) // range_bytes + 1, most)
    if ranges < 2:
        return []
    sampled = texts.where(F.rand(5) < ranges * samples / rows) if ranges * samples < rows else texts

    def begin(some: DataFrame) -> dict[bytes, int]:
        counts = some.groupBy(F.substring(raw, 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        return {bytes(r["p"]): r["n"] for r in counts.collect()}

    known = begin(sampled)
    # texts alike for a megabyte stay in one range
    while length < 1 << 20 and (crowded := {p for p, n in known.items() if n > samples and len(p) == length}):
        wanted = F.substring(raw, 1, length).isin([bytearray(p) for p in crowded])
        length *= 4
        known = {p: n for p, n in known.items() if p not in crowded} | begin(sampled.where(wanted))
    step, held, last, cuts = sum(known.values()) / ranges, 0, b"", []
    for p in sorted(known):
        if held >= step:
            cuts.append(p[: shared_length(last, p, 0) + 1])
            held = 0
        held, last = held + known[p], p
    return cuts


def range_of(text: bytes, cuts: list[bytes]) -> int:
    """The number of a text's range."""
    return bisect_right(cuts, text)
