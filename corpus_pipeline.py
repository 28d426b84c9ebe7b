"""A training corpus from raw documents: quality rules, near copies, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. run()
writes each stage's result as Parquet to the shared folder and reads it again as the next one's input.

Defined results: documents may hold columns of any other names, which are passed on as they are; an empty table gives no
rows. What each stage does with null and empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import ngram_join, packing, quality_rules, secret_scans, suffix_dedup
from mnemospark.llm.common import Scratch, table
from mnemospark.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them. Repeated rows are judged each on their own."""
    return quality_rules.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, or one without an id if none has any.

    Rows that share an id are told apart by their texts; of equal rows one stays. Texts without words have no copies.
    """
    return ngram_join.keep_one(spark, docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that occur elsewhere too are cut out of the texts; n_chars follows. Null texts stay null."""
    return suffix_dedup.stripped(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by a single mark; n_chars follows. Null and empty texts stay."""
    return secret_scans.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences. A null or empty text is its end token alone."""
    return packing.pack(spark, docs, byte_bpe())


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("suffix_array_dedup", repeated_strings), ("secret_scans", secrets), ("bestfit_packing", packed)]

#: The stages use a learned threshold, a suffix order and a tokenizer, which SQL cannot express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return docs
