"""Plain models of the operators, for small inputs; and inputs with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import combinations

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: names that the operators use for columns of their own
CLASHES = (
    "fp", "class", "component_id", "score", "predicted", "removed", "place", "digest", "rank", "file", "tokens", "take",
    "epoch", "budget", "words", "host", "rule", "verdict", "slot", "shard", "picked", "n", "next_id", "ids", "first", "kept",
)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(documents):
    from pyspark.sql import functions as F

    return documents.select("*", *(F.lit(-1).alias(c) for c in CLASHES))


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(1, 9))) for _ in range(vocabulary)]
    out = []
    for k in range(words):
        out.append(rng.choice(pool))
        out.append("\n" if k % 13 == 12 else ". " if k % 7 == 6 else " ")
    return "".join(out).strip()


def odd_documents():
    """NULL in every column, empty, blank and very long texts, repeated rows and copies."""
    long = prose(5, 30_000)
    return [
        (1, "", "en", "src0", 0),
        (2, None, "en", "src0", None),
        (None, prose(9, 80), "en", "src0", 5),
        (3, long, "en", "src1", len(long)),
        (4, prose(1, 130), None, None, None),
        (5, prose(1, 130), "de", "src2", 7),
        (5, prose(1, 130), "de", "src2", 7),
        (6, " \n\t\x0b ", "fr", "src0", 5),
        (7, "one", "fr", "", 3),
        (8, "ß É   日本語 😀 <|endoftext|> x", "xx", "src3", 9),
        (9, prose(2, 60) + "\n" + prose(1, 130).split("\n")[0], "es", "src1", 8),
        (None, None, None, None, None),
    ]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint(text, shingle):
    import xxhash

    w = words(ascii_lower(text or ""))
    units = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows, shingle=3, reach=3):
    """doc_id to the least doc_id reachable over fingerprints that differ in few bits; rows are (doc_id, text)."""
    prints = {i: fingerprint(t, shingle) for i, t in rows}
    return groups(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= reach])


def hashed_pieces(line, reach=4):
    """(body, words) of a line's pieces: they end behind words whose MD5 begins lower than those of four neighbours on either side."""
    bodies = re.findall(r"(?:^\s+)?\S+\s*", line)
    h = [hashlib.md5(x.strip().lower().encode()).digest()[:4] for x in bodies]
    out, held = [], []
    for k, body in enumerate(bodies):
        held.append(body)
        inner = reach <= k < len(h) - reach
        if k == len(h) - 1 or inner and all(h[k] < x for x in h[k - reach : k]) and all(h[k] <= x for x in h[k + 1 : k + reach + 1]):
            out.append(("".join(held), len(held)))
            held = []
    return out


def without_repeated_lines(rows, min_words=16):
    """(doc_id, text) rows to (text, spans that went) by doc_id."""
    key = lambda t: tuple(t.lower().split())
    units = {}  # doc_id: (start, line, (start, body, words) of its pieces)
    for doc_id, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            parts, off = [], at
            for body, n in hashed_pieces(line):
                parts.append((off, body, n))
                off += len(body)
            units.setdefault(doc_id, []).append((at, line, parts))
            at += len(line) + 1
    first = {}
    for doc_id, lines in units.items():
        for at, line, parts in lines:
            for start, body in [(at, line), *((s, b) for s, b, _ in parts)]:
                if key(body):
                    first[key(body)] = min(first.get(key(body), (doc_id, start)), (doc_id, start))
    out = {}
    for doc_id, text in rows:
        again = lambda start, body: bool(key(body)) and first[key(body)] != (doc_id, start)  # noqa: B023, E731
        flags = [(s, n, again(at, line) or again(s, b)) for at, line, parts in units[doc_id] for s, b, n in parts]
        goes, k = set(), 0
        while k < len(flags):
            end = k
            while end < len(flags) and flags[end][2]:
                end += 1
            if sum(n for _, n, _ in flags[k:end]) >= min_words:
                goes |= {s for s, _, _ in flags[k:end]}
            k = max(end, k + 1)
        kept, gone = [], []
        for at, line, parts in units[doc_id]:
            left = [b for s, b, _ in parts if s not in goes]
            if parts and not left and again(at, line):
                gone.append((at, at + len(line), *first[key(line)]))
            else:
                gone += [(s, s + len(b), *first[key(b)]) for s, b, _ in parts if s in goes]
            if left or not parts:
                kept.append(line if len(left) == len(parts) else "".join(left).rstrip())
        out[doc_id] = (None if text is None else "\n".join(kept), gone)
    return out


def divide(budget, children):
    """children: name to (holds, weight). Whole-number water filling, the neediest last."""
    open_, parts = dict(children), {}
    while True:
        total = sum(w for _, w in open_.values())
        full = [n for n, (holds, w) in open_.items() if holds * total <= budget * w]
        if not full:
            break
        n = min(full, key=lambda x: (open_[x][0] / open_[x][1], x))
        parts[n] = open_.pop(n)[0]
        budget -= parts[n]
    upto, total = 0, sum(w for _, w in open_.values())
    for n in sorted(open_, key=lambda x: (open_[x][0] / open_[x][1], x)):
        w = open_[n][1]
        parts[n] = budget * (upto + w) // total - budget * upto // total
        upto += w
    return parts


def mixed(rows, weights, share, epochs, seed):
    """rows: (doc_id, domain, lang, source, tokens) to (doc_id, epoch, take) triples."""
    leaves = defaultdict(int)
    for _, *leaf, tokens in rows:
        leaves[tuple(leaf)] += tokens
    budgets = {(): math.floor(sum(leaves.values()) * share)}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = defaultdict(lambda: defaultdict(int))
        for leaf, tokens in leaves.items():
            below[leaf[:depth]][leaf[depth]] += tokens * epochs
        after = {}
        for parent, kids in below.items():
            parts = divide(budgets[parent], {k: (h, weights.get(level, {}).get(k, 1)) for k, h in kids.items()})
            after |= {(*parent, k): n for k, n in parts.items()}
        budgets = after
    out = []
    for leaf, total in leaves.items():
        own = [(r[0], r[4]) for r in rows if tuple(r[1:4]) == leaf]
        if not total:
            continue
        whole, rest = divmod(budgets[leaf], total)
        out += [(i, e, n) for e in range(whole) for i, n in own]
        start = 0
        for i, n in sorted(own, key=lambda x: hashlib.md5(f"{seed}:{whole}:{x[0]}".encode()).hexdigest()):
            if start < rest:
                out.append((i, whole, min(n, rest - start)))
            start += n
    return out
