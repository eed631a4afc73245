"""Agreement of sources on one number, and which observation to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import finite


def to_numeric(value: Column) -> Column:
    """Text or number as a finite double, else null."""
    return finite(value.try_cast("double"))


def reconciled(
    observations: DataFrame,
    keys: tuple[str, ...] = ("entity_key", "field"),
    expected: tuple[str, ...] = (),
    absolute: float = 0.0,
    tolerance: float = 1e-4,
    minor: float | None = None,
) -> DataFrame:
    """Status of each key over the numeric values of its sources.

    Time is no part of the default key, so all dates of an entity's field are compared; pass it in ``keys`` to compare
    days. ``minor`` defaults to ten times ``tolerance``."""
    minor = 10 * tolerance if minor is None else minor
    value = to_numeric(F.col("value"))
    g = observations.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.abs(value)).alias("base"),
        F.collect_set(F.when(value.isNotNull(), F.col("source"))).alias("present"),
    )
    spread = F.col("high") - F.col("low")
    relative = F.when(F.col("base") == 0, 0.0).otherwise(spread / F.col("base"))
    missing = F.sort_array(F.array_except(F.array(*map(F.lit, expected)), "present")) if expected else F.array().cast("array<string>")
    lacks = F.size(missing) > 0
    agrees = (spread <= absolute) | (relative <= tolerance)
    status = (
        F.when(F.col("n") < 2, F.when(lacks, "missing").otherwise("unresolvable"))
        .when(agrees & lacks, "missing")
        .when(agrees, "agree")
        .when(relative <= minor, "minor_difference")
        .otherwise("conflicting")
    )
    return g.select(*keys, "n", spread.alias("spread"), relative.alias("relative"), status.alias("status"), F.array_join(missing, ",").alias("missing_sources"))


def chosen(
    observations: DataFrame,
    results: DataFrame,
    keys: tuple[str, ...] = ("entity_key", "field"),
    priority: tuple[str, ...] = (),
    allow_conflicting: bool = False,
) -> DataFrame:
    """The observation of the most preferred source for each key whose status allows one."""
    allowed = ["agree", "minor_difference"] + ["conflicting"] * allow_conflicting
    place = F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0)) if priority else F.lit(None).cast("long")
    order = F.struct(F.coalesce(place, F.lit(2**31)), "source", "observation_id")
    numeric = observations.where(to_numeric(F.col("value")).isNotNull())
    best = numeric.groupBy(*keys).agg(F.min_by(F.struct("observation_id", "source", to_numeric(F.col("value")).alias("value")), order).alias("o"))
    return best.join(results.where(F.col("status").isin(*allowed)).select(*keys, "status"), list(keys)).select(*keys, "status", "o.*")
