"""Exact dedup by a tree-merge of sorted digest runs, with DataFrame operations only.

Every row falls into one of ``runs`` runs by a hash of its id. A run is the sorted list of the digests of its
rows, each with the best row so far and a count (Spark's sort aggregation, pre-aggregated before the shuffle).
In binomial rounds ``fan_in`` neighbouring runs meet: the multiway merge keeps the best row of each digest, until
one run is left. The winners then go back down level by level: a run gets them from the run that it was merged into, so
that a digest which a third of all rows share is spread over ``runs`` keys on the way down too, and no group is gathered.

The smallest identifier of a digest is verified at every level by more than the digest: SHA-256, length and a second,
independent 64-bit hash of the normalised text are the merge key. Texts themselves are not compared again.

Defined results: null text is the empty text; empty texts are equal to each other; the row with the most code
points in its original text stays, then the smallest id (null ids first), then - for rows repeated with their id -
any one of them. Empty input gives an empty result. Other columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WS, materialise, unused

KEY = ("sha", "n_norm", "check")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256) -> DataFrame:
    """One small row for each document: id, row number, run, digest key and code points of the original text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("text"), F.regexp_replace(text, WS, "").alias("norm"))
        .select(
            "id",
            F.monotonically_increasing_id().alias("row"),
            F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.octet_length("norm").cast("long").alias("n_norm"),
            F.xxhash64("norm").alias("check"),
            F.length("text").cast("long").alias("n_points"),
        )
    )


def merge_tree(rows: DataFrame, runs: int, fan_in: int) -> list[DataFrame]:
    """The levels of the tree, leaves first: (digest key, run) -> best row and count."""
    best = F.struct((-F.col("n_points")).alias("less"), F.col("id"), F.col("row"))
    levels = [rows.groupBy(*KEY, "run").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))]
    while runs > 1:
        runs = -(-runs // fan_in)
        levels.append(
            levels[-1]
            .groupBy(*KEY, F.floor(F.col("run") / fan_in).cast("int").alias("run"))
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
    return levels


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16) -> DataFrame:
    """One row for each row of ``docs``: (id_col, row, keep_id, group_size, kept, n_norm, sha)."""
    rows = materialise(digest_rows(docs, id_col, text_col, runs), "digests")
    levels = merge_tree(rows, runs, fan_in)
    winners = levels[-1].select(*KEY, "run", "best", "n")
    for level in reversed(levels[:-1]):
        into = F.floor(F.col("run") / fan_in).cast("int")
        won = winners.withColumnRenamed("run", "into")
        winners = level.select(*KEY, "run", into.alias("into")).join(won, [*KEY, "into"]).drop("into")
    return rows.join(winners, [*KEY, "run"]).select(
        F.col("id").alias(id_col),
        "row",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "n_norm",
        "sha",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tree: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat an id with an equal text are told apart by their position only; such rows, and no
    others, are aggregated to the longest of them."""
    groups = exact_groups(docs, id_col, text_col, **tree)
    key_id, key_sha, copies, n, row_sha = unused(docs, "_id", "_sha", "_copies", "_n", "_row_sha")
    stay = groups.groupBy(F.col(id_col).alias(key_id), F.col("sha").alias(key_sha)).agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias(copies)
    )
    stay = materialise(stay.where("kept").drop("kept"), "stay")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(row_sha, F.unhex(F.sha2(F.regexp_replace(text, WS, ""), 256)))
    on = F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(row_sha) == F.col(key_sha))
    single = keyed.join(stay.where(F.col(copies) == 1), on, "left_semi")
    repeated = keyed.join(stay.where(F.col(copies) > 1), on)
    longest = repeated.groupBy(key_id, key_sha).agg(F.max_by(F.struct(*single.columns), F.length(text)).alias(n))
    return single.unionByName(longest.select(f"{n}.*")).drop(row_sha)
