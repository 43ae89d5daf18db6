"""A training corpus from raw documents: texts in a known language, one of each group of near duplicates, no benchmark passages, sources in
their weights, and token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkgrid.llm import decontam, langid, mixing, similarity, tokens
from inkgrid.llm.common import forget, keep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of rows that aren't held out, and rejects texts without letters and those of doubtful language.

    Null and empty texts have no letters and go; a null label teaches nothing; rows that repeat stay or go together; an empty table stays empty. All columns are kept.
    """
    model = langid.train(docs.where(langid.remainder("doc_id") != 0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return langid.accept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group that is linked by five-word shingles at a similarity of 0.8 or more: that with the smallest id.

    Texts without words, null ones too, are one group. Of rows that repeat an id one stays; rows with a null id all stay. An empty table stays empty. All columns are kept.
    """
    return similarity.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten consecutive words of a benchmark item, or with the whole of a shorter one.

    Null and empty texts have no words and stay; null items hit nothing; rows that repeat stay or go together; an empty table stays empty. All columns are kept.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their weights: each document none, one or several times, at most three.

    A null source is a source of its own; null texts and those without words are as often there as their source's sure copies; rows that repeat an id, null ids too, are drawn each
    on its own. An empty table stays empty. All columns are kept.
    """
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the files, and gives a row for each document in them.

    Null and empty texts have the end id alone; null ids come first and come back as null; rows that repeat are written as often; an empty table gives none.
    """
    return tokens.read_tokens(spark, tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]

#: SQL can't express learned languages, fingerprints and byte-pair encoding; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before, which is deleted when it isn't needed any more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        new = stage(spark, docs, sf_dir)  # the last one has written its files when it returns
        if i < len(STAGES) - 1:
            new = keep(new, f"pipeline-{name}")
        if i:
            forget(docs)
        docs = new
    return docs
