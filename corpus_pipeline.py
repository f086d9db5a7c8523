"""The corpus pipeline: documents through five operators of ``shelf.llm``, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm import bpe, mixing, quality_model, simhash, units
from shelf.llm.common import table, words
from shelf.llm.queries import WEIGHTS, domain, tokenizer_file
from shelf.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: rows that go to a Python worker at a time; whole texts take much memory there
BATCH_ROWS = 1000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    return quality_model.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within 3 bits, the one with the smallest ``doc_id``."""
    return simhash.drop_near_copies(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; a document of which nothing remains goes."""
    cut = units.remove_repeats(docs.select(*COLUMNS))
    gone = (F.size("removed") > 0) & (F.size(words(F.col("text"))) == 0)
    return _measured(cut.where(~gone))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The prefix of one epoch that each source's share of nine tenths of all words pays for."""
    return _measured(mixing.mix_documents(docs.select(*COLUMNS), domain(), WEIGHTS, share=0.9, epochs=1))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    return bpe.digests(bpe.round_trip(docs.select(*COLUMNS), tokenizer_file("byte_bpe_50k.json")), "ids")


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date with ``text``."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def in_small_batches(stage: Stage) -> Stage:
    """The stage under a setting that keeps what a Python worker holds of its texts small."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", in_small_batches(quality_classifier)),
    ("near_dedup", in_small_batches(near_dedup)),
    ("substring_dedup", in_small_batches(substring_dedup)),
    ("source_mixing", in_small_batches(source_mixing)),
    ("bpe_coding", in_small_batches(bpe_coding)),
]

#: classifier, fingerprints and byte pairs have no SQL; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = materialize(docs, name)
    return docs
