"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm import langid, mixing, packing, simhash_dedup
from setloom.llm.common import table, write_out
from setloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing lang is filled in, a given one stays.

    A null text or one without a letter goes, and one whose two best languages are too close.
    """
    found = langid.identify(docs, langid.dictionaries(docs), keep=docs.columns, prefix="_langid_")
    filled = F.coalesce(F.col("lang"), F.nullif(F.col("_langid_lang_pred"), F.lit(langid.UNKNOWN)))
    return found.where("not _langid_rejected").withColumn("lang", filled).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the least doc_id."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture places it, so that sources have their target weights."""
    return mixing.mix(docs, keep=docs.columns, placement=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a repeat is a document of its own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: DuckDB can't express compression, fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_out(stage(spark, docs, sf_dir), name)
    return docs
