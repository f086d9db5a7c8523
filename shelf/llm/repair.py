"""Token ids of a corpus in files, compressed by a Re-Pair grammar per shard.

Documents are dealt out by ranges of ``doc_id``; each task encodes its documents in order and cuts the stream of ids
into shards of about a million. In a shard, frequent pairs of neighbouring symbols are replaced by new symbols again and
again, until no pair is there 32 times. A round replaces many pairs at once: the most frequent first, as long as no
symbol would be the left half of one pair and the right half of another, so that replacements cannot overlap. (A pair of
equal symbols is taken from the left in every run.) Pairs may reach over the end of a document.

The file format is a Parquet table, one row a shard:

    first_id, shard    the first document of the task that wrote it, and the shard's number in that task
    n_tokens           ids in the shard
    doc_ids, lengths   of each document: int64; number of ids, int64
    terminals          the id of each symbol below the first rule, uint32
    rules              two symbols a rule, uint32; rule r is the symbol len(terminals) + r
    expansions         number of ids that each rule stands for, int64
    symbols            the compressed stream, of `width` bytes each

all numbers little-endian. Sums over ``expansions`` say which symbols hold any range of ids, so a reader expands only
those.

Defined results: a NULL text counts as empty; an empty text is just the end id. Documents that share a ``doc_id`` follow
each other in the order of their texts. Documents without ``doc_id`` come first. An empty table makes no shard.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, compress
from operator import not_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm.common import per_worker
from shelf.scratch import materialize

NO_ID = -(2**63)
#: ASCII punctuation: behind a letter or digit it begins a new word for the tokenizer; not >, which ends special tokens
MARKS = b"!\"#$%&'()*+,-./:;<=?@[\\]^_`{|}~"
#: rounds visit single places once frequent pairs are at fewer than one in so many places
SPARSE = 12
FORMAT = (
    "first_id long, shard int, n_tokens long, doc_ids binary, lengths binary, terminals binary, rules binary,"
    " expansions binary, symbols binary, width int"
)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``starts``, one after the other."""
    ends = sizes.cumsum()
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def roomy(array: np.ndarray, needed: int) -> np.ndarray:
    """The array, or a copy with twice as many places as are ``needed`` where it has too few."""
    if needed <= len(array):
        return array
    grown = np.zeros(2 * needed, array.dtype)
    grown[: len(array)] = array
    return grown


class _Places(dict):
    """Numbers pieces as they are met; ``met`` lists those that are new."""

    def __init__(self):
        super().__init__()
        self.met: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = place = len(self) + 1
        self.met.append(piece)
        return place


class Encoder:
    """The tokenizers library behind a table of the pieces (between white space) that a task has met.

    The tokenizer must lower-case its input, drop white space and cut words at it, and mark the end of each word, as the
    files of the kind "BPE with word ends" do; then a text's ids are those of its pieces, one after the other.
    """

    def __init__(self, path: str, end_id: int, most_pieces: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.end_id, self.most_pieces = end_id, most_pieces
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        # place 0 is the end of a document; the arrays have room for more
        self.flat, self.starts, self.sizes = np.array([self.end_id], np.int32), np.array([0]), np.array([1])
        self.filled = 1

    def _enter(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        places = list(map(self.place.__getitem__, pieces))
        self.starts[places] = self.filled + sizes.cumsum() - sizes
        self.sizes[places] = sizes
        self.flat = roomy(self.flat, self.filled + len(ids))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Enter the pieces that are new; a word with marks behind it is put together from both, which part anyway."""
        place, split, halves, whole = self.place, [], [], []
        for piece in place.met:
            stem = piece.rstrip(MARKS)
            if len(stem) < len(piece) and stem[-1:].isalnum():  # bytes: an ASCII letter or digit
                split.append(piece)
                halves += stem, piece[len(stem) :]
            else:
                whole.append(piece)
        known = len(place.met)
        halves = [place[half] for half in halves]
        whole += place.met[known:]
        place.met = []
        self.starts, self.sizes = roomy(self.starts, len(place) + 1), roomy(self.sizes, len(place) + 1)

        texts = b" ".join(whole).decode().split(" ") if whole else []
        letters = list(map(str.isalpha, texts))
        words, others = list(compress(texts, letters)), list(compress(texts, map(not_, letters)))
        word_places, other_places = list(compress(whole, letters)), list(compress(whole, map(not_, letters)))
        if words:  # one word each: their ids part where a word ends
            ids = np.array(self._ids([" ".join(words)])[0], np.int64)
            last = np.flatnonzero(self.ends_word[ids])
            if len(last) == len(words):
                self._enter(word_places, ids, np.diff(last, prepend=-1))
            else:  # some letter falls into several characters
                others, other_places = others + words, other_places + word_places
        if others:
            found = self._ids(others)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._enter(other_places, np.fromiter(chain.from_iterable(found), np.int64), sizes)
        if split:
            sizes = self.sizes[halves]
            ids = ragged(self.flat, self.starts[halves], sizes)
            self._enter(split, ids, sizes.reshape(-1, 2).sum(1))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it; number of ids of each)."""
        if len(self.place) > self.most_pieces:
            self._forget()
        places: list[int] = []
        last = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            if b"<|" not in raw:  # else lower-casing could make a special token
                raw = raw.lower()  # A-Z only; the library does the rest
            places += map(self.place.__getitem__, raw.split())  # at the six ASCII spaces
            last[k] = len(places)
            places.append(0)
        if self.place.met:
            self._learn()
        at = np.fromiter(places, np.int64, len(places))
        sizes = self.sizes[at]
        return ragged(self.flat, self.starts[at], sizes), np.diff(sizes.cumsum()[last], prepend=0)


def _counted(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are there ``least`` times or more, ascending, and how often."""
    pairs = np.sort(pairs)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    uses = np.diff(np.append(first, len(pairs)))
    often = uses >= least
    return pairs[first[often]].astype(np.uint64), uses[often]


def _apart(pairs: np.ndarray, uses: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to replace together in one round, the most frequent first: no symbol is in both halves, and none twice in one."""
    order = np.argsort(-uses, kind="stable")
    left, right, chosen = set(), set(), []
    for a, b in zip((pairs[order] >> np.uint64(32)).tolist(), (pairs[order] & np.uint64(2**32 - 1)).tolist(), strict=True):
        if a not in left and a not in right and b not in left and (a != b or b not in right):
            chosen.append((a, b))
            left.add(a)
            right.add(b)
    return chosen


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right


def _round(known: np.ndarray, uses: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a round; each left half's right half; each left half's new symbol."""
    chosen = np.array(_apart(known, uses), np.uint32)
    partner = np.full(alphabet, alphabet, np.uint32)  # the alphabet's size: nobody's partner
    partner[chosen[:, 0]] = chosen[:, 1]
    name = np.zeros(alphabet, np.uint32)
    name[chosen[:, 0]] = alphabet + np.arange(len(chosen))
    return chosen, partner, name


def _every_other(hit: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places that overlap with the one before (``follows``), every other one from the first of their run."""
    place = np.arange(len(hit))
    return hit[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]


def _with_left(places: np.ndarray, left: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The places and those to their ``left``, but none that is ``taken`` by the one before or lies before the stream."""
    return np.concatenate([places, left[left != np.append(-1, taken[:-1])]])


def _recounted(
    known: np.ndarray, uses: np.ndarray, gone: np.ndarray, fresh: np.ndarray, fresh_uses: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pairs, ascending, and their uses, after ``gone`` (a pair as often as it went) and with ``fresh`` ones."""
    gone = np.sort(gone)
    uses = uses - (np.searchsorted(gone, known, "right") - np.searchsorted(gone, known, "left"))
    left = uses >= least
    known, uses = np.concatenate([known[left], fresh]), np.concatenate([uses[left], fresh_uses])
    order = np.argsort(known)
    return known[order], uses[order]


def _among(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which pairs are ``known`` (ascending)."""
    if not len(known):
        return np.zeros(len(pairs), bool)
    return known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs


def _dense_rounds(stream: np.ndarray, known: np.ndarray, uses: np.ndarray, least: int, alphabet: int, rules: list) -> tuple:
    """Rounds that pass over the whole stream, as long as frequent pairs fill a good part of it."""
    while len(known) and int(uses.sum()) * SPARSE > len(stream):
        chosen, partner, name = _round(known, uses, alphabet)
        hit = np.flatnonzero(partner[stream[:-1]] == stream[1:])
        hit = _every_other(hit, np.diff(hit, prepend=-2) == 1)
        at = np.concatenate([hit + 1, _with_left(hit, hit - 1, hit + 1)])
        at = at[at < len(stream) - 1]
        gone = _pairs(stream[at], stream[at + 1])
        stream[hit] = name[stream[hit]]
        kept = np.ones(len(stream), bool)
        kept[hit + 1] = False
        stream = stream[kept]
        new = hit - np.arange(len(hit))  # each replacement before took a place
        at = _with_left(new, new - 1, new)
        at = at[at < len(stream) - 1]
        known, uses = _recounted(known, uses, gone, *_counted(_pairs(stream[at], stream[at + 1]), least), least)
        rules += map(tuple, chosen.tolist())
        alphabet += len(chosen)
    return stream, known, uses, alphabet


def _sparse_rounds(stream: np.ndarray, known: np.ndarray, uses: np.ndarray, least: int, alphabet: int, rules: list) -> np.ndarray:
    """The rounds that are left, over the places of frequent pairs alone; a linked list says who neighbours whom."""
    n = len(stream)
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    alive = np.ones(n, bool)
    stream = np.append(stream, np.uint32(2**32 - 1))  # behind the last symbol; in no frequent pair
    lefts, rights = np.zeros(alphabet, bool), np.zeros(alphabet, bool)
    lefts[known >> np.uint64(32)] = True
    rights[known & np.uint64(2**32 - 1)] = True
    places = np.flatnonzero(lefts[stream[: n - 1]] & rights[stream[1:n]])
    places = places[_among(_pairs(stream[places], stream[places + 1]), known)]
    while len(known):
        chosen, partner, name = _round(known, uses, alphabet)
        hit = np.unique(places[partner[stream[places]] == stream[after[places]]])
        hit = _every_other(hit, np.append(-1, after[hit[:-1]]) == hit)
        second = after[hit]
        at = np.concatenate([second, _with_left(hit, before[hit], second)])
        gone = _pairs(stream[at], stream[after[at]])
        stream[hit] = name[stream[hit]]
        alive[second] = False
        after[hit] = after[second]
        before[after[hit]] = hit
        at = _with_left(hit, before[hit], hit)
        at = at[after[at] < n]
        near = _pairs(stream[at], stream[after[at]])
        fresh, fresh_uses = _counted(near, least)
        known, uses = _recounted(known, uses, gone, fresh, fresh_uses, least)
        places = np.concatenate([places[alive[places]], at[_among(near, fresh)]])  # some of pairs that are rare by now
        if len(places) > 2 * uses.sum():
            places = places[_among(_pairs(stream[places], stream[after[places]]), known)]
        rules += map(tuple, chosen.tolist())
        alphabet += len(chosen)
    return stream[:n][alive]


def build_grammar(ids: np.ndarray, least: int = 32) -> dict[str, np.ndarray]:
    """Terminals, rules, expansions and symbols of a stream of ids in which no pair is left ``least`` times.

    All pairs are counted once. A round takes what it replaces off the counts and adds the pairs round the new symbols, which are the
    only ones that can have become frequent. Once frequent pairs are rare in the stream, rounds visit only their places.
    """
    terminals = np.flatnonzero(np.bincount(ids))
    symbol = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    symbol[terminals] = np.arange(len(terminals))
    stream = symbol[ids]
    if len(terminals) <= 65_536:  # half the bytes to sort
        known, uses = _counted(stream[:-1] << np.uint32(16) | stream[1:], least)
        known = _pairs(known >> np.uint64(16), known & np.uint64(65_535))
    else:
        known, uses = _counted(_pairs(stream[:-1], stream[1:]), least)
    rules: list[tuple[int, int]] = []
    stream, known, uses, alphabet = _dense_rounds(stream, known, uses, least, len(terminals), rules)
    if len(known):
        stream = _sparse_rounds(stream, known, uses, least, alphabet, rules)
    expansions = np.ones(len(terminals) + len(rules), np.int64)
    for r, (a, b) in enumerate(rules, len(terminals)):
        expansions[r] = expansions[a] + expansions[b]
    return {
        "terminals": terminals.astype("<u4"),
        "rules": np.array(rules, "<u4").reshape(-1, 2),
        "expansions": expansions[len(terminals) :].astype("<i8"),
        "symbols": stream.astype("<u2" if len(expansions) <= 65_536 else "<u4"),
    }


class Grammar:
    """Reads one shard."""

    def __init__(self, terminals: bytes, rules: bytes, expansions: bytes, symbols: bytes, width: int):
        self.symbols = np.frombuffer(symbols, f"<u{width}")
        terminal_ids = np.frombuffer(terminals, "<u4")
        self.sizes = np.concatenate([np.ones(len(terminal_ids), np.int64), np.frombuffer(expansions, "<i8")])
        self.starts = self.sizes.cumsum() - self.sizes
        self.flat = np.empty(int(self.sizes.sum()), "<u4")  # what every symbol stands for
        self.flat[: len(terminal_ids)] = terminal_ids
        halves = np.frombuffer(rules, "<u4").reshape(-1, 2).tolist()
        starts, sizes = self.starts.tolist(), self.sizes.tolist()
        for r, (a, b) in enumerate(halves, len(terminal_ids)):
            at, middle, end = starts[r], starts[r] + sizes[a], starts[r] + sizes[r]
            self.flat[at:middle] = self.flat[starts[a] : starts[a] + sizes[a]]
            self.flat[middle:end] = self.flat[starts[b] : starts[b] + sizes[b]]
        self.ends = self.sizes[self.symbols].cumsum()

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``, from the symbols that hold them."""
        if begin >= end:
            return self.flat[:0]
        first, last = np.searchsorted(self.ends, [begin, end - 1], side="right")
        held = self.symbols[first : last + 1]
        skipped = begin - int(self.ends[first] - self.sizes[held[0]])
        return ragged(self.flat, self.starts[held], self.sizes[held])[skipped : skipped + end - begin]


def write_shards(documents: DataFrame, tokenizer: str, end_id: int = 1, shard_tokens: int = 1 << 20, name: str = "shards") -> DataFrame:
    """Encode every document, write the shards to a table in the shared folder, and return that table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = per_worker(("pieces", tokenizer, end_id), lambda: Encoder(tokenizer, end_id))
        first_id = None
        number, held, doc_ids, lengths = 0, [], [], []

        def shard() -> pd.DataFrame:
            ids = np.concatenate(held)
            packed = build_grammar(ids)
            row = {
                "first_id": first_id,
                "shard": number,
                "n_tokens": len(ids),
                "doc_ids": np.concatenate(doc_ids).astype("<i8").tobytes(),
                "lengths": np.concatenate(lengths).astype("<i8").tobytes(),
                **{k: v.tobytes() for k, v in packed.items()},
                "width": packed["symbols"].itemsize,
            }
            return pd.DataFrame([row])

        for frame in frames:
            for at in range(0, len(frame), 250):  # about a shard's worth of documents at a time
                part = frame.iloc[at : at + 250]
                ids, sizes = encoder.encode(part["text"].tolist())
                names = part["doc_id"].to_numpy(np.int64)
                first_id = int(names[0]) if first_id is None else first_id
                begin = 0
                for k, end in enumerate(sizes.cumsum().tolist()):
                    filled = sum(map(len, held)) + end - int(sizes[:begin].sum())
                    if filled >= shard_tokens or k == len(sizes) - 1:
                        base = int(sizes[:begin].sum())
                        held.append(ids[base:end])
                        doc_ids.append(names[begin : k + 1])
                        lengths.append(sizes[begin : k + 1])
                        begin = k + 1
                    if filled >= shard_tokens:
                        yield shard()
                        number, held, doc_ids, lengths = number + 1, [], [], []
        if held:
            yield shard()

    known = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    ordered = known.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInPandas(run, FORMAT), name)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(first_id, shard, start): how many ids come before each shard. Only the totals of tasks meet in one place."""
    heads = shards.select("first_id", "shard", "n_tokens")
    totals = heads.groupBy("first_id").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1))
    tasks = totals.select("first_id", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("first_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = heads.withColumn("inside", F.coalesce(inside, F.lit(0))).join(tasks, "first_id")
    return placed.select("first_id", "shard", (F.col("base") + F.col("inside")).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ``ids`` as little-endian 32-bit numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                grammar = Grammar(row.terminals, row.rules, row.expansions, row.symbols, row.width)
                doc_ids, lengths = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.lengths, "<i8")
                ends = lengths.cumsum()
                ids = [grammar.ids(e - n, e).tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": doc_ids, "start": row.start + ends - lengths, "n_tokens": lengths, "ids": ids})

    starts = materialize(shard_starts(shards), "starts")
    found = shards.join(starts, ["first_id", "shard"]).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def coded(documents: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written files."""
    found = read_documents(write_shards(documents, tokenizer, end_id))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
