"""From raw documents to token ids: each stage works on all that the one before kept, written as Parquet.

For every stage: rows whose doc_id is null or repeated are documents like others, each judged by its own
text. Columns beyond those the stage reads pass through unchanged, whatever their names; a null in them
means nothing. Without documents each stage returns none, with its columns. Long texts are worked on
whole. What a stage does with null and empty texts and with ties stands below. A stage has no more
tasks than the size of its input asks for, so it writes no more files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontaminate, langid, pii, simhash
from tidelog.llm.common import by_size, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some known language. A text that is null or has no letter is in none and
    goes. A null lang becomes the predicted one, of languages that fit equally well the alphabetically
    first. Without labelled text no language is known, and all documents go."""
    return langid.accepted(by_size(docs, docs), langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked. Texts that are null, empty or without
    words all have fingerprint zero and make one group. Of rows that tie in their id one stays."""
    return by_size(simhash.one_of_each(docs), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null and short texts hold none and stay; copies of a document
    stay or go together. Without a benchmark all stay."""
    return by_size(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced. Null and empty texts stay as they are; equal values get
    equal pseudonyms; where finders overlap, the one that the operator names first decides."""
    return pii.pseudonymise(by_size(docs, docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's whole text, with a digest of what they decode to. Null is read as
    empty, which has no ids. One row for each document, repeated ones too."""
    return bpe.encode_documents(by_size(docs, docs), public_tokenizers.path("word_bpe_49k.json"), form=bpe.IDS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", pseudonymise),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The fingerprints and the automata have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None
