"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what a stage returns is written
as Parquet and read again. All but the last return the columns of documents, whatever further columns that table has.

Defined results: a null text counts as empty everywhere; a null doc_id is a row like any other and comes first where rows
are ordered; rows that repeat id and text become one row in the exact dedup; an empty table gives an empty table of the
stage's columns; texts are never cut but by the passage stage, and documents above 2048 ids become several pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, near_dedup, pack, quality, suffix_dedup
from quantloom.llm.common import materialise, table, tokenizer_path, unused


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.7 go; without labels of both kinds all scores are 0.5
    and, as nothing is known to be bad, all documents stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.not_held_out())
    if not model.good:
        return docs
    (found,) = unused(docs, "_quality")
    scored = quality.score(docs, model, docs.columns, out_col=found)
    return scored.where(F.col(found) >= 0.7).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the longest stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.near_dedup(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 100 bytes that start earlier go; n_chars follows the text."""
    left = suffix_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2048 ids, with their ids, and their places in as few sequences as possible."""
    pieces = pack.tokenise(docs, tokenizer_path("word_bpe_49k.json"), max_len=2048)
    return pack.pack(pieces, max_len=2048)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Compression, signatures, suffix order and tokenization are not SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialise(docs, f"stage{n}")
    return docs
