"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

A word's bytes form a doubly linked list of symbols. A priority queue holds the merge rank and place of every adjacent
pair that has a merge; the least entry is applied, the two new neighbour pairs are queued, and an entry whose symbols
have changed since it was queued is skipped. Decoding concatenates the byte strings of the ids.

Words repeat, so a task keeps the ids of the words it has met in a table of bounded size. Texts of any length take
time in proportion to their length (times the logarithm of the longest word).

Defined results: NULL counts as the empty text, which has no ids. A special token's string in a text becomes its id.
Ids that the vocabulary lacks cannot be decoded and raise an error; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: how byte-level BPE cuts a text into words (white space by its Unicode property)
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary: itself if it prints, else one from U+0100 on.

    The ranges of bytes that print are fixed values: 33-126, 161-172, 174-255.
    """
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in prints else next(spare)) for b in range(256)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, cached_words: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        byte_of = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}
        self.cached_words = cached_words

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one word, by a queue of merges over a linked list of symbols."""
        symbols: list[int | None] = [self.of_byte[b] for b in word.encode("utf-8", "replace")]
        merges, end = self.merges, len(symbols)
        after = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        queue = [
            (found[0], at, pair[0], pair[1], found[1])
            for at, pair in enumerate(zip(symbols, symbols[1:], strict=False))
            if (found := merges.get(pair))
        ]
        heapq.heapify(queue)
        while queue:
            _, at, left, right, merged = heapq.heappop(queue)
            gone = after[at]
            if symbols[at] != left or gone == end or symbols[gone] != right:
                continue  # stale
            symbols[at], symbols[gone] = merged, None
            after[at] = following = after[gone]
            if following < end:
                before[following] = at
                if found := merges.get((merged, symbols[following])):
                    heapq.heappush(queue, (found[0], at, merged, symbols[following], found[1]))
            previous = before[at]
            if previous >= 0 and (found := merges.get((symbols[previous], merged))):
                heapq.heappush(queue, (found[0], previous, symbols[previous], merged, found[1]))
        return tuple([s for s in symbols if s is not None])

    def _plain(self, text: str, ids: list[int]) -> None:
        known = self.known
        for word in self.words.findall(text):
            found = known.get(word)
            if found is None:
                found = self.encode_word(word)
                if len(word) <= 64:
                    if len(known) >= self.cached_words:
                        known.clear()
                    known[word] = found
            ids += found

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        if self.marks is None or not any(mark in text for mark in self.special):
            self._plain(text, ids)
            return ids
        for part in self.marks.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                self._plain(part, ids)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(documents: DataFrame, path: str, cached_words: int = 200_000) -> DataFrame:
    """(doc_id, ids, decoded) of every document; ``path`` names a tokenizer file that every executor can read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(path, cached_words)
        for frame in frames:
            for at in range(0, len(frame), 500):  # a few MB of ids at a time
                part = frame.iloc[at : at + 500]
                ids = [codec.encode(text) for text in part["text"]]
                decoded = [codec.decode(x) for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": ids, "decoded": decoded})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of a round trip, and what more of its columns is wanted."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
