"""A corpus pipeline of the training-data operators: each stage takes the
documents that the stage before it kept and returns documents; the last one
returns their tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regula.llm import linededup, minhash, mixing, quality, sentencepiece_codec
from regula.session import cut_lineage, prepare

PIECE_MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    prepare(spark)
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or nearly equal lines the first one in the corpus stays; a
    document keeps its other lines, and its row even if no line is left."""
    prepare(spark)
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    prepare(spark)
    return minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    prepare(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with byte spans, and digests of the round trip."""
    prepare(spark)
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", source_mix),
    ("sentencepiece", encode),
]

#: SQL has no word for the fuzzy and tokenising stages; tests/llm checks the rows and
#: columns of the whole, and each stage's operator against its own plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
