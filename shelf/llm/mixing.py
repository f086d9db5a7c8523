"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree: domain, language, source. A budget of tokens runs from the root down. At each node it is
divided among the children by weight; a child that holds less than its part gets what it holds, and its shortage goes
to its siblings by weight. Only what all siblings together cannot use is missing at the node itself, and so reaches
the node's own siblings. A node holds what its leaves hold in ``epochs`` passes.

A leaf's stream is a sequence of epochs, each a seeded permutation of the leaf's documents; the leaf takes the prefix
of that stream that its budget pays for. Whole epochs need no order. In the last one documents are filed by the
leading digits of their seeded digest: files before the one where the budget ends are taken whole, and only that one
file is sorted, so no task ever holds a leaf.

Defined results: token counts are words; NULL and empty texts have none, are taken where their place in the stream is
before the budget's end, and cost nothing. A leaf without any token is not taken. NULL in a level's column is a node of
its own, named ''. Rows that repeat a ``doc_id`` in a leaf share one place in the stream; if the budget ends there, each is
cut to what was left. A NULL ``doc_id`` is such a name too. Other columns pass through. All sums are whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.llm.common import words
from shelf.scratch import materialize

LEVELS = ("domain", "lang", "source")


def _weight(column: str, given: Mapping[str, int]) -> Column:
    """A node's weight among its siblings: as given, else 1."""
    found = F.lit(1)
    for name, weight in given.items():
        found = F.when(F.col(column) == name, weight).otherwise(found)
    return found


def _divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide the parent's ``budget`` among siblings with ``holds`` and ``weight``; ``budget`` becomes the child's part."""
    wide = "decimal(20,0)"
    by_need = Window.partitionBy(*parent).orderBy(F.col("holds") / F.col("weight"), name)
    all_before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("holds").over(all_before), F.lit(0))
    marked = nodes.withColumn(
        "full",
        F.col("holds").cast(wide) * F.sum("weight").over(from_here).cast(wide) <= left.cast(wide) * F.col("weight").cast(wide),
    )
    open_weight = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    summed = marked.select(
        "*",
        (F.col("budget") - F.sum(F.when(F.col("full"), F.col("holds")).otherwise(0)).over(family)).cast(wide).alias("rest"),
        F.sum(open_weight).over(family).cast(wide).alias("open"),
        F.sum(open_weight).over(by_need.rowsBetween(Window.unboundedPreceding, 0)).cast(wide).alias("upto"),
    )
    # shares of a running total: whole numbers that add up to the rest
    part = F.expr("(rest * upto) div open - (rest * (upto - weight)) div open")
    return summed.select(*parent, name, F.when(F.col("full"), F.col("holds")).otherwise(part).alias("budget"))


def budgets(
    leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float = 0.6, epochs: int = 2, levels: tuple = LEVELS
) -> DataFrame:
    """(levels, tokens, budget): what each leaf of (levels, tokens) may take of ``share`` of all tokens."""
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(share))).cast("long"))
    parent: list[str] = []
    for level in levels:
        nodes = leaves.groupBy(*parent, level).agg((F.sum("tokens") * epochs).alias("holds"))
        weighted = nodes.withColumn("weight", _weight(level, weights.get(level, {}))).where("weight > 0")
        given = weighted.join(plan, parent) if parent else weighted.withColumn("budget", total.scalar())
        plan = _divide(given, parent, level)
        parent = [*parent, level]
    return leaves.join(plan, list(levels), "left").select(*levels, "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))


def word_counts(documents: DataFrame, domain: Column) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) of every document, without its text."""
    named = [F.coalesce(c, F.lit("")).alias(n) for n, c in (("domain", domain), ("lang", F.col("lang")), ("source", F.col("source")))]
    return documents.select("doc_id", *named, F.size(words(F.col("text"))).cast("long").alias("tokens"))


def _rank(epoch: Column, seed: int) -> Column:
    """A document's place in an epoch: the seeded digest of its ``doc_id``, in hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def stream_ends(
    counted: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float = 0.6, epochs: int = 2, seed: int = 7,
    digits: int = 3, levels: tuple = LEVELS,
) -> DataFrame:
    """(levels, whole, end_rank, end_take): where each leaf's prefix ends, one row a leaf.

    ``whole`` epochs are taken in full. Of the next one every document ranked before ``end_rank`` is taken, and
    ``end_take`` tokens of the one at it; both are NULL where the budget ends with an epoch. ``digits`` is the number
    of digits that name a file of that epoch. ``counted`` has (doc_id, levels, tokens) and is read several times.
    """
    names = list(levels)
    leaves = materialize(counted.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    spend = budgets(leaves, weights, share, epochs, levels).select(
        *names,
        F.expr("if(tokens = 0, 0, budget div tokens)").cast("int").alias("whole"),
        F.expr("if(tokens = 0, 0, budget % tokens)").alias("rest"),
    )
    spend = materialize(spend, "spend")
    last = counted.join(spend.where("rest > 0"), names).withColumn("rank", _rank(F.col("whole"), seed))
    file = F.substring("rank", 1, digits).alias("file")
    running = Window.partitionBy(*names).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = last.groupBy(*names, "rest", file).agg(F.sum("tokens").alias("holds"))
    files = files.withColumn("before", F.coalesce(F.sum("holds").over(running), F.lit(0)))
    where_it_ends = files.where("before < rest and rest <= before + holds").select(*names, "file", "before")
    inside = Window.partitionBy(*names).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        last.select("*", file)
        .join(where_it_ends, [*names, "file"])
        .groupBy(*names, "rest", "before", "rank")
        .agg(F.sum("tokens").alias("holds"))
        .withColumn("start", F.col("before") + F.coalesce(F.sum("holds").over(inside), F.lit(0)))
        .where("start < rest and rest <= start + holds")
        .select(*names, F.col("rank").alias("end_rank"), (F.col("rest") - F.col("start")).alias("end_take"))
    )
    return materialize(spend.join(ends, names, "left").select(*names, "whole", "end_rank", "end_take"), "ends")


def _taken(rows: DataFrame, ends: DataFrame, seed: int, levels: tuple) -> DataFrame:
    """``rows`` once for each epoch that takes them, with ``epoch`` and ``end_take`` (NULL: the whole document).

    ``ends`` has one row a leaf and its size is known from its file, so the planner broadcasts it where that is safe.
    """
    keep = [c for c in rows.columns]
    epoch = F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("epoch")
    every = rows.join(ends, list(levels)).select(*keep, "whole", "end_rank", "end_take", epoch)
    rank = _rank(F.col("epoch"), seed)
    return (
        every.withColumn("rank", F.when(F.col("epoch") == F.col("whole"), rank))
        .where((F.col("epoch") < F.col("whole")) | (F.col("rank") <= F.col("end_rank")))
        .select(*keep, "epoch", F.when(F.col("rank") == F.col("end_rank"), F.col("end_take")).alias("end_take"))
    )


def mix(counted: DataFrame, weights: Mapping[str, Mapping[str, int]], seed: int = 7, levels: tuple = LEVELS, **how) -> DataFrame:
    """(doc_id, levels, epoch, tokens, take) for every document and epoch that the mix takes; ``take`` of its tokens.

    ``counted`` has (doc_id, levels, tokens). ``take`` is less than ``tokens`` only where a leaf's budget ends.
    """
    counted = materialize(counted.select("doc_id", *levels, "tokens"), "counted")
    taken = _taken(counted, stream_ends(counted, weights, seed=seed, levels=levels, **how), seed, levels)
    return taken.select("doc_id", *levels, "epoch", "tokens", F.least("tokens", "end_take").alias("take"))


def first_words(text: str, count: int) -> str:
    """The text up to the end of its word number ``count``."""
    at = 0
    for place, word in enumerate(text.split()):
        if place == count:
            return text[:at]
        at = text.index(word, at) + len(word)
    return text


def mix_documents(
    documents: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], seed: int = 7, **how
) -> DataFrame:
    """The documents that the mix takes, once for each epoch, with all their columns; the text at a leaf's end is cut."""
    ends = stream_ends(materialize(word_counts(documents, domain), "counted"), weights, seed=seed, **how)
    leaf = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    rows = documents.select(
        "doc_id", F.struct(*documents.columns).alias("row"), *(F.coalesce(c, F.lit("")).alias(n) for n, c in leaf.items())
    )

    @F.pandas_udf("string")
    def cut(text: pd.Series, take: pd.Series) -> pd.Series:
        return pd.Series([t if pd.isna(n) else first_words(t, int(n)) for t, n in zip(text, take, strict=True)], dtype=object)

    taken = _taken(rows, ends, seed, LEVELS)
    return taken.select(*(cut("row.text", "end_take").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns))
