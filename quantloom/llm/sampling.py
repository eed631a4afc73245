"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def per_class(rows: DataFrame, class_col: str, id_col: str, n: int, salts: tuple[int, ...] = (512, 8, 1)) -> DataFrame:
    """At most ``n`` rows of each class: those with the smallest hashes of their ids. The smallest of each of many parts
    are found first, then of fewer, so that a class with most of the rows never meets in one task."""
    hashed = rows.withColumn("_h", F.xxhash64(id_col))
    for parts in salts:
        order = Window.partitionBy(class_col, F.pmod("_h", F.lit(parts))).orderBy("_h", id_col)
        hashed = hashed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    return hashed.drop("_h")


def spread_blocks(text: Column, most: int, block: int = 4096) -> Column:
    """The text if it has at most ``most`` characters, else evenly spaced blocks of it that make up about as many."""
    number = max(most // block, 1)
    last = F.length(text) - block
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(number - 1)),
        lambda k: F.substring(text, (F.floor(k * last / max(number - 1, 1)) + 1).cast("int"), F.lit(block)),
    )
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(blocks, "\n"))


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, class_col: str, most: int) -> list[tuple]:
    """(class, text) of the chosen ids, of longer texts evenly spaced blocks of ``most`` characters. ``chosen`` is bounded
    by its parameters, so it is broadcast and collected."""
    picked = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(F.broadcast(chosen.select(F.col(id_col).alias("_id"), F.col(class_col).alias("_class"))), "_id")
    )
    found = picked.select("_class", spread_blocks(F.col("_text"), most).alias("_text")).collect()
    return sorted((r["_class"], r["_text"]) for r in found)
