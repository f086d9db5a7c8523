import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import clashing, frame, odd_documents, prose

from shelf.llm import bpe, repair

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))


def noise(count, seed=3):
    rng = random.Random(seed)
    letters = [chr(x) for x in [*range(128)] * 3] + list("\x85\xa0\u1680\u2003\u2028\u3000\u200b😀中é\u0301İΣσẞ٢²Ⅰ\u212bﬁ\U0010ffff")
    letters += [" "] * 50 + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "the", "Å"] * 4 + list("xyz.,!?") * 6
    return ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(count)]


@pytest.fixture(scope="module")
def byte_library():
    return tokenizers.Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(WORDS)


def test_bpe_equals_the_library(byte_library):
    codec = bpe.Codec(BYTES, cached_words=50)  # forgets all the time
    for text in [*noise(3000), prose(1, 500), "a" * 5000, " " * 300 + "\n" * 9]:
        ids = byte_library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == byte_library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, byte_library):
    rows = odd_documents()
    got = bpe.digests(bpe.round_trip(clashing(frame(spark, rows)), BYTES)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = byte_library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(byte_library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(frame(spark, []), BYTES).collect() == []


def test_pieces_equal_the_library(word_library):
    encoder = repair.Encoder(WORDS, 1, most_pieces=2000)
    texts = [*noise(3000, 4), prose(1, 500), "x" * 3000]
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        ids, sizes = encoder.encode([*part, None])
        want = [word_library.encode(t, add_special_tokens=False).ids + [1] for t in part] + [[1]]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("kind", ["prose", "run", "noise", "short", "many"])
def test_grammar_is_reversible_and_seekable(kind):
    rng = np.random.default_rng(5)
    ids = {
        "prose": np.tile(rng.integers(0, 300, 400), 60),
        "run": np.full(5001, 7),
        "noise": rng.integers(0, 50_000, 20_000),
        "short": np.array([3]),
        "many": rng.integers(0, 200_000, 150_000),
    }[kind]
    packed = repair.build_grammar(ids)
    grammar = repair.Grammar(*(packed[k].tobytes() for k in ("terminals", "rules", "expansions", "symbols")), packed["symbols"].itemsize)
    assert np.array_equal(grammar.ids(0, len(ids)), ids)
    for _ in range(100):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert np.array_equal(grammar.ids(a, b), ids[a:b])
    if kind in ("prose", "run"):
        assert len(packed["symbols"]) < len(ids) / 5
    uses = np.bincount(packed["symbols"], minlength=len(packed["terminals"]) + len(packed["rules"]))
    assert packed["rules"].size == 0 or uses.sum() == len(packed["symbols"])


@pytest.mark.parametrize("least", [2, 5, 32])
def test_grammar_leaves_no_frequent_pair_however_its_rounds_find_their_places(least, monkeypatch):
    rng = np.random.default_rng(least)
    streams = [
        np.zeros(0, np.int64),
        np.array([3, 3]),
        np.full(1000, 7),
        np.tile([1, 2, 3], 500),
        rng.integers(0, 3, 3000),
        rng.integers(0, 30, 20_000),
        np.repeat(rng.integers(0, 5, 800), rng.integers(1, 9, 800)),
        np.concatenate([rng.integers(0, 70_000, 70_000), np.tile([9, 9, 8], 400)]),
    ]
    for ids in streams:
        packed = {}
        for sparse in (0, 4, 10**9):  # single places only, both, the whole stream only
            monkeypatch.setattr(repair, "SPARSE", sparse)
            packed[sparse] = repair.build_grammar(ids, least)
        for name, values in packed[0].items():
            assert np.array_equal(values, packed[4][name]) and np.array_equal(values, packed[10**9][name])
        symbols = packed[0]["symbols"].tolist()
        uses, free = Counter(), {}
        for place, pair in enumerate(zip(symbols, symbols[1:])):
            if free.get(pair, 0) <= place:  # a run of one symbol holds half as many pairs
                uses[pair] += 1
                free[pair] = place + 2
        assert max(uses.values(), default=0) < least


def test_files_hold_every_document_in_order(spark, word_library):
    rows = odd_documents()
    shards = repair.write_shards(clashing(frame(spark, rows)), WORDS, shard_tokens=500)
    assert shards.count() > 1
    got = {}
    for r in repair.read_documents(shards).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, zlib.crc32(r.ids)))
    at = 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(word_library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (at, len(ids), zlib.crc32(ids.tobytes())) in got[doc_id]
        at += len(ids)
    assert sum(map(len, got.values())) == len(rows)


def test_files_of_an_empty_table(spark):
    assert repair.coded(frame(spark, []), WORDS).collect() == []
