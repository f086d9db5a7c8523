"""Document fingerprints by winnowing.

Every run of ``k`` words is hashed. Of each window of ``w`` neighbouring hashes the least is picked, the rightmost of
equal ones, and a pick shared by neighbouring windows counts once. So any passage of ``w + k - 1`` words that two
documents share gives both the same pick, and every pick keeps its position, which says where the match lies.

Words are lower-cased and separated by the six ASCII spaces. Only Spark SQL functions are used.

Defined results: a text of fewer than ``k`` words is one run; one of fewer than ``w`` runs is one window. NULL, empty and
blank texts have no picks; two of them have the likeness 1, and 0 with any other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shelf.llm.common import let, words
from shelf.scratch import materialize

LAST = 2**32 - 1


def picks(text: Column, k: int = 4, w: int = 6) -> Column:
    """The picks of a text in order of position: 32 bits of hash, then the position counted down from 2^32 - 1."""

    def runs(hashes: Column) -> Column:
        count = F.greatest(F.size(hashes) - (k - 1), F.least(F.size(hashes), F.lit(1)))
        # a text of fewer than k words: what lies beyond its end is NULL and left out of the hash
        return F.transform(
            F.slice(hashes, F.lit(1), count),
            lambda h, at: F.shiftleft(F.xxhash64(h, *(F.get(hashes, at + j) for j in range(1, k))), 32).bitwiseOR(
                F.lit(LAST) - at.cast("long")
            ),
        )

    def least(run: Column) -> Column:
        windows = F.greatest(F.size(run) - (w - 1), F.least(F.size(run), F.lit(1)))
        return F.array_distinct(
            F.transform(F.slice(run, F.lit(1), windows), lambda _, at: F.array_min(F.slice(run, at + 1, F.lit(w))))
        )

    hashes = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    return let(let(hashes, runs), least)


def hashes(picked: Column) -> Column:
    return F.transform(picked, lambda p: F.shiftright(p, 32).cast("int"))


def positions(picked: Column) -> Column:
    """The number of the first word of each pick."""
    return F.transform(picked, lambda p: F.lit(LAST) - p.bitwiseAND(F.lit(LAST)))


def written(picked: Column) -> Column:
    """The picks as text: hash and position of each."""
    one = lambda p: F.concat_ws(
        "@", F.lower(F.hex(F.shiftrightunsigned(p, 32))), (F.lit(LAST) - p.bitwiseAND(F.lit(LAST))).cast("string")
    )
    return F.array_join(F.transform(picked, one), " ")


def likeness(one: Column, other: Column) -> Column:
    """Shared hashes over all hashes of two lists of hashes."""
    counts = F.struct(F.size(F.array_intersect(one, other)), F.size(F.array_union(one, other)))
    return let(counts, lambda c: F.when(c["col2"] == 0, 1.0).otherwise(c["col1"] / F.greatest(c["col2"], F.lit(1))))


def successors(documents: DataFrame) -> DataFrame:
    """(doc_id, n, next_id, next_rank) of every ``doc_id``: the next larger one, after the last the first.

    ``n`` is the longest text's length. Of several rows of an id one stands for it as another's next document: the shortest, of
    equally long ones one picked by hash, named by its rank. Ids are dealt out by ranges; only the first id of each
    range, one row a partition, meets in one place.
    """
    ids = documents.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("rank").alias("rank"))
    own = F.struct("doc_id", "rank")
    dealt = ids.repartitionByRange("doc_id").select("doc_id", "n", "rank", F.spark_partition_id().alias("part"))
    dealt = materialize(dealt, "ranges")
    heads = dealt.groupBy("part").agg(F.min(own).alias("head"))
    by_part = Window.orderBy("part")
    first = F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), first).alias("after"))
    within = F.lead(own).over(Window.partitionBy("part").orderBy("doc_id"))
    chain = dealt.select("doc_id", "n", "part", within.alias("inside")).join(heads, "part")
    after = F.coalesce("inside", "after")
    return materialize(chain.select("doc_id", "n", after["doc_id"].alias("next_id"), after["rank"].alias("next_rank")), "chain")


def edit_study(documents: DataFrame, k: int = 4, w: int = 6) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is the next document's beginning.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row a document. Rows
    that share a ``doc_id`` have the same next document; where they are the next one themselves, the shortest stands for
    them. A row without ``doc_id`` has no next document: its edited text ends early, and ``near_next`` is NULL.
    """
    text = F.coalesce("text", F.lit(""))
    # of equal lengths by 31 bits of a hash
    rank = F.shiftleft(F.length("text").cast("long"), 31).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit(2**31 - 1)))
    # a cast that changes nothing would leave a new name on one of the sides below, and they would no longer be the same
    ids = F.col("doc_id") if documents.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id")
    known = documents.select(ids, text.alias("text"))
    known = known.select("doc_id", "text", rank.alias("rank"))
    length = F.shiftright("rank", 31).cast("int").alias("n")
    named = known.where("doc_id is not null")
    chain = successors(named.select("doc_id", length, "rank"))
    # the texts cross the network once, by doc_id and for both sides below; picks are made where they arrive. Both sides
    # need the same columns for that, and ranks are held equal by two comparisons: as a key they would part the sides
    after = chain.select("next_id", "next_rank", F.col("doc_id").alias("before"), F.col("n").alias("longest"))
    following = named.join(after, F.col("doc_id") == F.col("next_id")).where("rank >= next_rank and rank <= next_rank")
    following = following.select("before", F.expr("substring(text, 1, longest div 4)").alias("head"), hashes(picks(F.col("text"), k, w)).alias("next_hashes"))
    # rows that are equal, or of one rank, are one
    following = following.groupBy("before").agg(F.min(F.struct("head", "next_hashes")).alias("f")).select("before", "f.*")
    both = named.join(following, F.col("doc_id") == F.col("before")).select("doc_id", length, "text", "head", "next_hashes")
    alone = known.where("doc_id is null").select(
        "doc_id", length, "text", F.lit("").alias("head"), F.lit(None).cast("array<int>").alias("next_hashes"))
    edited = both.union(alone).select(
        "doc_id", "n", "text", "next_hashes",
        F.concat(F.expr("substring(text, 1, n - n div 4)"), F.expr("substring(head, 1, n div 4)")).alias("edited"),
    )
    judged = edited.select(
        "doc_id", "n", "next_hashes", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(F.struct(picks(F.col("text"), k, w).alias("own"), picks(F.col("edited"), k, w).alias("edited"))).alias("p"),
    )
    judged = judged.select("*", F.explode_outer("p").alias("e"))  # a generator: worked out once; outer, for else picks are made in a filter too
    own, other = F.col("e.own"), F.col("e.edited")
    return judged.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        written(own).alias("fingerprint"),
        written(other).alias("edited_fingerprint"),
        likeness(hashes(own), hashes(other)).alias("near_edited"),
        F.when(F.col("next_hashes").isNotNull(), likeness(hashes(own), F.col("next_hashes"))).alias("near_next"),
    )
