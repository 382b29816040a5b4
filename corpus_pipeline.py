"""Corpus pipeline: documents through language ID, quality rules, near-duplicate
removal and packing. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs.
A table without rows gives one without rows at every stage. Other columns than text and doc_id, nulls in them included, decide
nothing but in ``language``, which learns from lang; columns beyond those of documents pass through to the last stage. Texts of
any length are read whole."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vekta.llm import language_id, ngram_join, packing, quality_rules
from vekta.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Null and empty texts and texts without a letter have none and go;
    copies share one verdict; where no row has a lang, nothing is known and all rows go."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the raw corpus is this stage's input. Null and empty texts have too few words
    and go; copies share one verdict; without a trusted label all ratios are 0."""
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, quality_rules.fit_ratios(docs, trusted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id (a null one last), and one row of it if it
    repeats. Null and empty texts have no words in common with any other and stay."""
    return ngram_join.one_of_each(docs, ngram_join.near_duplicates(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens. Null and empty texts are their end id alone; repeated rows are packed as often as they
    come; longer documents are cut into pieces."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, keep_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("pack", pack)]

# The stages fit models and sample tokens, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
