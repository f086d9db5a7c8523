"""Conversation prefixes against a plain model."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelf.llm import conversation_trie as trie
from shelf.llm import queries

COLUMNS = "conv_id long, turn long, role string, text string"


def paths_of(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = paths.get(lender, [])[:h] + own[h:]
    return out


def nodes_of(paths):
    members = defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    for prefix, m in members.items():
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children[prefix]
            saved[prefix[:d]] += (len(m) - 1) * len(prefix[-1][1].encode()) if prefix else 0
    out = set()
    for prefix, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.add((min(m), len(prefix), parent, len(m), children[prefix], leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talk(seed, convs, vocabulary=3, longest=9):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", f"say {rng.randrange(vocabulary)} é")
        for c in convs for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("size,shard", [(64, 4096), (3, 5), (1, 1)])
def test_nodes_equal_a_plain_model(spark, size, shard):
    rows = talk(1, range(60)) + [(c, t, "user", "the same") for c in range(100, 140) for t in range(5)]
    got = trie.digested(trie.trie(trie.chunked(spark.createDataFrame(rows, COLUMNS), size), shard))
    assert found(got) == nodes_of(paths_of(rows))


def test_query_rebuilds_and_survives_odd_rows(spark, tmp_path):
    rows = talk(2, [*range(-7, 25), *range(41, 60), 10**12, 10**12 + 3])
    rows += [(7, None, "user", "first of all"), (8, 0, None, None), (8, 3, "user", None), (9, 1, "", ""), (9, 1, "", "")]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), (30, None, None, None)]
    rows += [(70, t, "user", f"{t}") for t in range(300)] + [(71, t, "user", f"{t}") for t in range(0, 300)] + [(66, 2, "user", "alone")]
    rows += [(80, 1, "user", "x" * 200_000)]
    frame = spark.createDataFrame(rows, COLUMNS).select("*", F.lit(1).alias("depth"), F.lit(2).alias("k1"), F.lit(3).alias("turns"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_trie(spark, str(tmp_path))
    assert found(got) == nodes_of(rebuilt(paths_of(rows)))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_trie(spark, str(tmp_path)).count() == 0


def test_a_conversation_of_many_turns_is_cut(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(3000)] + [(3, t, "user", f"{t % 2999}") for t in range(3000)]
    chunks = trie.chunked(spark.createDataFrame(rows, COLUMNS).repartition(7))
    assert chunks.agg(F.max(F.size("turns"))).first()[0] == trie.CHUNK
    got = trie.trie(chunks).nodes
    assert got.count() == 3002 and got.where("n_convs = 3").count() == 3000
    assert got.where("depth = 0").first().saved_tokens == sum(2 * len(str(t)) for t in range(2999)) + 4


def test_an_end_list_comes_in_parts(spark):
    rows = [(c, 0, "user", "hi") for c in range(500)]
    out = trie.trie(trie.chunked(spark.createDataFrame(rows, COLUMNS)), shard=7)
    assert out.ends.count() > 50
    ends = ",".join(map(str, range(500)))
    assert trie.digested(out).where("depth = 1").first().ends_sha256 == hashlib.sha256(ends.encode()).hexdigest()
