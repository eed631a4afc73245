"""Holdings, insider transactions and large deals of many instruments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import ratio

HOLDERS = ("promoter", "public", "fii", "dii", "government")
WINDOWS = (30, 90, 365)
#: Words that tell the side of a transaction; selling words are looked at first.
SELLING = "sell|sale|disposal|disposed|transfer out|pledge"
BUYING = "buy|purchase|acquisition|acquired|allotment|esop"
#: Fields that may carry the time of an event, in order of precedence.
EVENT_TIMES = ("event_date", "intimation_date", "trade_date", "transaction_date", "announcement_date", "ex_date", "record_date", "event_time")


def event_time(df: DataFrame) -> Column:
    return F.coalesce(*(F.col(c).cast("timestamp") for c in EVENT_TIMES if c in df.columns))


def shareholding_changes(snapshots: DataFrame, holders: tuple[str, ...] = HOLDERS) -> DataFrame:
    """The latest snapshot of each instrument against, for each holder, the nearest earlier one that has the field."""
    w = Window.partitionBy("instrument_id").orderBy("period_end")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = snapshots.withColumns({f"{h}_before": F.last(h, ignorenulls=True).over(past) for h in holders})
    latest = rows.withColumn("k", F.row_number().over(w.orderBy(F.col("period_end").desc()))).where("k = 1")
    return latest.select("instrument_id", "period_end", *holders, *((F.col(h) - F.col(f"{h}_before")).alias(f"{h}_change") for h in holders))


def signed(df: DataFrame, text: str = "transaction_type") -> DataFrame:
    """Adds signed_quantity and signed_value: bought less sold where a row says both, else by the words of its type."""
    there = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    b, s, bv, sv = (there(c) for c in ("buy_quantity", "sell_quantity", "buy_value", "sell_value"))
    words = F.lower(F.col(text)) if text in df.columns else F.lit("")
    side = F.when(words.rlike(SELLING), -1).when(words.rlike(BUYING), 1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    explicit = b.isNotNull() | s.isNotNull()
    direction = F.signum(zero(b) - zero(s))
    quantity = F.when(explicit, zero(b) - zero(s)).otherwise(side * zero(there("quantity")))
    value = F.when(bv.isNotNull() | sv.isNotNull(), zero(bv) - zero(sv)).when(explicit, direction * zero(there("value"))).otherwise(side * zero(there("value")))
    return df.withColumn("signed_quantity", quantity).withColumn("signed_value", value)


def in_windows(df: DataFrame, windows: tuple[int, ...], as_of: Column | None) -> DataFrame:
    """Rows of each window of days up to an anchor, both ends inclusive: ``as_of``, or the last event of the instrument.

    The anchor is joined from an aggregation, and a row is repeated once for each window that holds it."""
    if as_of is None:
        df = df.join(df.groupBy("instrument_id").agg(F.max("event_time").alias("anchor")), "instrument_id")
    else:
        df = df.withColumn("anchor", as_of).where(F.col("event_time") <= F.col("anchor"))
    rows = df.withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    return rows.where(F.col("event_time") >= F.col("anchor") - F.make_dt_interval("window"))


def bought_and_sold(quantity: Column, value: Column) -> list[Column]:
    up, down = (lambda x: F.sum(F.when(x > 0, x).otherwise(0.0))), (lambda x: F.sum(F.when(x < 0, -x).otherwise(0.0)))
    return [
        up(quantity).alias("buy_quantity"), down(quantity).alias("sell_quantity"), F.sum(quantity).alias("net_quantity"),
        up(value).alias("buy_value"), down(value).alias("sell_value"), F.sum(value).alias("net_value"),
    ]


def insider_activity(df: DataFrame, windows: tuple[int, ...] = WINDOWS, as_of: Column | None = None, person: str = "person_name") -> DataFrame:
    rows = in_windows(signed(df), windows, as_of)
    g = rows.groupBy("instrument_id", "window").agg(
        F.count(F.lit(1)).alias("transactions"), F.count_distinct(person).alias("people"), *bought_and_sold(F.col("signed_quantity"), F.col("signed_value"))
    )
    return g.select(
        "*", ratio(F.col("buy_quantity"), F.col("sell_quantity")).alias("quantity_ratio"), ratio(F.col("buy_value"), F.col("sell_value")).alias("value_ratio")
    )


def large_deals(df: DataFrame, windows: tuple[int, ...] = WINDOWS, as_of: Column | None = None) -> DataFrame:
    """Deals (side, quantity, price, value, client, deal_type) by window, with the types and how many of each."""
    notional = F.when((F.col("quantity") != 0) & (F.col("price") != 0), F.col("quantity") * F.col("price")).otherwise(F.coalesce("value", F.lit(0.0)))
    rows = in_windows(df.withColumn("notional", notional), windows, as_of)
    side = F.lower("side")
    on = lambda word: F.sum(F.when(F.contains(side, F.lit(word)), F.col("notional")).otherwise(0.0))
    by_type = rows.groupBy("instrument_id", "window", "deal_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("notional").alias("gross"), on("buy").alias("buy"), on("sell").alias("sell")
    )
    clients = rows.groupBy("instrument_id", "window").agg(F.count_distinct("client").alias("clients"))
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("deal_type", "n"))), lambda x: F.concat(x["deal_type"], F.lit(":"), x["n"].cast("string"))), ",")
    g = by_type.groupBy("instrument_id", "window").agg(
        F.sum("n").alias("deals"), F.sum("gross").alias("gross_value"), F.sum("buy").alias("buy_value"), F.sum("sell").alias("sell_value"), kinds.alias("types")
    )
    g = g.withColumn("net_value", F.col("buy_value") - F.col("sell_value")).withColumn("ratio", ratio(F.col("buy_value"), F.col("sell_value")))
    return g.join(clients, ["instrument_id", "window"])
