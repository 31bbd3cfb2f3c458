"""Corpus pipeline: language ID, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs.  All but the last return the columns of documents.

Results: texts that are null, empty or blank go in the first stage.  Rows without doc_id pass the near-duplicate stage and
sort before others in the last two.  Repeated rows share their verdicts; one of them stays after the near-duplicates.  An
empty table gives no rows.  Columns beyond those of documents are carried to the last stage and not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evispark.llm import importance, language_id, packing, simhash, suffix_dedup
from evispark.llm.common import clean_up, materialize, table, written

#: Near-duplicates of the pipeline: five-word shingles of Jaccard similarity 0.8 or more, held against the texts.  Pairs
#: are proposed by bands of minimum hashes and by fingerprints, whose two-word shingles flip fewer bits than longer ones.
NEAR = {"words": 2, "radius": 3, "shingle": 5, "least": 0.8}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, which becomes their lang; those without a letter or in no language's order go."""
    return language_id.accepted(docs, language_id.learn(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes."""
    return importance.sampled(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word similarity 0.8 or more make."""
    return simhash.one_of_each(docs, **NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has."""
    return suffix_dedup.cut_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: No stage can be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage wrote on its way is deleted once its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "zstd")
        clean_up(spark, [docs], before)
    return STAGES[-1][1](spark, docs, sf_dir)
