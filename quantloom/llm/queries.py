"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    htmltext,
    kmeans,
    langid,
    licenses,
    line_clean,
    near_dedup,
    pack,
    quality,
    sql,
    suffix_dedup,
    vector_dedup,
)
from quantloom.llm.common import table, tokenizer_path


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_copies(table(spark, sf_dir, "documents"), ["doc_id"], width=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.not_held_out())
    scored = quality.score(docs, model, ["doc_id"])
    held_out = F.coalesce(~quality.not_held_out(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"), with_similarity=True)
    return classes.select("doc_id", "class_id", "class_size", "kept", "similarity")


def op5_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_clean.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed"
    )


def op6_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, langid.not_held_out()), ["doc_id"])
    held_out = F.coalesce(~langid.not_held_out(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = htmltext.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.tokenise(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), max_len=2048)
    packed = pack.pack(pieces, max_len=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, decoded=True)
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def op11_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(table(spark, sf_dir, "embeddings"), n_clusters=40, rounds=5, dim=64)


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_license_rules": op2_license_rules,
        "op3_quality_compression": op3_quality_compression,
        "op4_dart_minhash": op4_dart_minhash,
        "op5_line_clean": op5_line_clean,
        "op6_language_ppm": op6_language_ppm,
        "op7_html_tag_paths": op7_html_tag_paths,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_int8_tiles": op11_int8_tiles,
        "op12_hamerly": op12_hamerly,
        "op13_dual_tree": op13_dual_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_rules": sql.license_scan(),
        "op5_line_clean": sql.LINE_CLEAN,
        "op10_exact_dedup": sql.EXACT_DEDUP,
        "op11_int8_tiles": sql.NEAR_VECTORS,
        "op12_hamerly": sql.clusters(),
        "op13_dual_tree": sql.HARD_NEGATIVES,
    }
