"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; the last returns the digests of the encoding.
``run`` writes every stage to the shared folder, reads it again and removes what the
stage wrote on its way.

Every stage takes empty tables, nulls in any column, texts of any length and columns
of other names than documents has (they are carried along, whatever they are called);
a row without text counts as one with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attestra.llm import bpe, chosen_path, decontaminate, pii, quality
from attestra.llm._shared import clean_up, made, written
from attestra.llm.queries import quality_held_out, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for: a score of 0.5 or more, a tie of votes included. Equal texts are judged equally; texts without words get the mean label."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), quality_held_out())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, null last; of repeated rows one. Two texts under one doc_id are two documents. Texts without words are near duplicates of none, so all stay that differ in doc_id or text."""
    return chosen_path.deduplicated(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; all rows with the same text stay or go together, and rows without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, also repeated ones, personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, also repeated ones, as digests; a null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", not_in_benchmark), ("pii", without_personal_data), ("bpe", encoded)]

#: No stage but the last could be put in SQL: the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clean_up(spark, keep=docs, since=before)
    return docs
