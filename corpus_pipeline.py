"""From raw documents to token ids: five stages, each a DataFrame in and a DataFrame out.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageweave.llm import bpe_stream, grouped_prefix, mixing, quality_rules, sentence_spans
from pageweave.llm.common import shared_dir, table, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules reject go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (runs of five words, similarity of 0.8 or more) stays."""
    return grouped_prefix.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that an earlier document or the same text already had go."""
    return sentence_spans.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every document of the mix."""
    return bpe_stream.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", substrings),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Pivotal rounding is a fold over hashed draws and the last stage a byte-pair encoder: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each but the last is written to the shared folder and read again, without what it made on its way."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
