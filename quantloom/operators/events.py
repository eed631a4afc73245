"""Company events: counts by window, and how prices moved after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import days_between
from quantloom.operators.market import prepared
from quantloom.operators.ownership import WINDOWS, in_windows

TYPES = ("event_type", "deal_type", "action_type", "record_type")


def event_type(df: DataFrame, default: str = "event") -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in TYPES if c in df.columns), F.lit(default))


def company_summary(df: DataFrame, windows: tuple[int, ...] = WINDOWS, as_of: Column | None = None) -> DataFrame:
    """Events by instrument and window: how many, of which types, the last one and days since it at the anchor."""
    rows = in_windows(df.withColumn("_type", event_type(df)), windows, as_of)
    by_type = rows.groupBy("instrument_id", "window", "_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last"), F.max("anchor").alias("anchor"))
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_type", "n"))), lambda x: F.concat(x["_type"], F.lit(":"), x["n"].cast("string"))), ",")
    g = by_type.groupBy("instrument_id", "window").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("distinct_types"), kinds.alias("types"), F.max("last").alias("last_event"), F.max("anchor").alias("anchor")
    )
    return g.withColumn("days_since", days_between(F.col("anchor"), F.col("last_event"))).drop("anchor")


def market_reaction(events: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """Returns from the first price strictly after an event over the next ``k`` prices; null where there are too few.

    A forward as-of join without a range join: prices carry their own forward returns; both tables are laid in one order
    within each day of an instrument, where an event takes the next price row. What follows a day comes from a table of
    one row for each day of an instrument, so an instrument with most events is spread over its days. Only positive
    prices count."""
    w = Window.partitionBy("instrument_id").orderBy("ts")
    p = prepared(prices).where("close > 0")
    forward = [(F.lead("close", k).over(w) / F.col("close") - 1).alias(f"return_{k}") for k in horizons]
    p = p.select("instrument_id", "ts", F.struct(F.col("ts").alias("base_ts"), F.col("close").alias("base_price"), *forward).alias("next"))
    p = p.select("instrument_id", F.col("ts").alias("at"), "next", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(0).alias("is_event"))
    e = events.select("instrument_id", F.col("event_time").alias("at"), F.lit(None).cast(p.schema["next"].dataType).alias("next"), "event_id", F.lit(1).alias("is_event"))
    rows = p.unionByName(e).withColumn("day", F.col("at").cast("date"))
    # backwards in time, and at one instant events first, so that an event never takes a price of its own instant
    order = Window.partitionBy("instrument_id", "day").orderBy(F.col("at").desc(), F.col("is_event").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("same_day", F.last("next", ignorenulls=True).over(order)).where("is_event = 1")
    days = rows.groupBy("instrument_id", "day").agg(F.min_by("next", F.when(F.col("is_event") == 0, F.col("at"))).alias("first"))
    after = Window.partitionBy("instrument_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    later = days.select("instrument_id", "day", F.first("first", ignorenulls=True).over(after).alias("later"))
    found = found.join(later, ["instrument_id", "day"], "left").withColumn("found", F.coalesce("same_day", "later"))
    return found.select("instrument_id", "event_id", F.col("at").alias("event_time"), "found.*")
