"""The registered queries of this subpackage: thin, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm import (
    bpe,
    conversation_trie,
    divergence,
    filter_audit,
    language_id,
    mixing,
    quality_model,
    repair,
    sharding,
    simhash,
    units,
    url_filter,
    winnowing,
)
from shelf.llm.common import table


def domain() -> Column:
    """The mixing tree's first level: sources in three domains by their number."""
    number = F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("long")
    return F.when(number % 3 == 1, "books").when(number % 3 == 2, "forums").otherwise("web")


WEIGHTS = {"domain": {"web": 4, "books": 3, "forums": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}}


SHARDS = [f"shard-{n:02}" for n in range(64)]


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op2_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = units.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select(
        "doc_id",
        "text",
        F.size("removed").alias("n_removed"),
        F.array_join(
            F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"], r["first_doc_id"], r["first_start"])), ","
        ).alias("removed"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents", "doc_id"), "doc_id", SHARDS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    )


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.coded(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(bpe.round_trip(documents, tokenizer_file("byte_bpe_50k.json")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.mix(mixing.word_counts(documents, domain()), WEIGHTS)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_study(table(spark, sf_dir, "documents", "doc_id", "text"))


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = conversation_trie.chunked(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    own = F.col("conv_id")
    rebuilt = conversation_trie.with_head_of(chunks, own - own % 5, F.crc32(own.cast("string").cast("binary")) % 9, most=8)
    return conversation_trie.digested(conversation_trie.trie(rebuilt))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.judge(documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return filter_audit.audit(documents, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_divergence": op1_divergence,
        "op2_repeated_units": op2_repeated_units,
        "op3_sharding": op3_sharding,
        "op4_simhash": op4_simhash,
        "op5_quality_model": op5_quality_model,
        "op6_repair": op6_repair,
        "op7_bpe": op7_bpe,
        "op8_mixing": op8_mixing,
        "op9_winnowing": op9_winnowing,
        "op10_url_filter": op10_url_filter,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_language_id": op12_language_id,
        "op13_filter_audit": op13_filter_audit,
    }
