"""Row-set operators on records: keyed dedup, grouping, filtering, price validation and price reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Natural keys of the record types and which of equal records stays. Null key parts are equal to each other.
KEYS: dict[str, tuple[tuple[str, ...], str]] = {
    "price_bars": (("instrument_id", "timeframe", "timestamp", "source"), "last"),
    "price_bars_all_sources": (("instrument_id", "timeframe", "timestamp"), "last"),
    "instruments": (("instrument_id",), "last"),
    "corporate_actions": (("instrument_id", "action_type", "announcement_date", "ex_date", "record_date", "ratio", "amount"), "last"),
    "company_events": (("event_id",), "last"),
    "shareholding": (("instrument_id", "period_end"), "last"),
    "insider_transactions": (("event_id",), "last"),
    "large_deals": (("event_id",), "last"),
    "index_snapshots": (("index_symbol", "timestamp"), "last"),
    "index_constituents": (("index_symbol", "symbol"), "last"),
    "macro_observations": (("series_id", "observation_date"), "last"),
    "news": (("news_key",), "first"),
    "regulatory_items": (("regulatory_id",), "last"),
}


def one_of_each(df: DataFrame, keys: tuple[str, ...], order: Column, which: str = "last") -> DataFrame:
    """One row for each key: the last (or first) by ``order``, which must be unique within a key.

    An aggregation with a pre-aggregated struct, so a key that most rows share never meets in one task."""
    pick = F.max_by if which == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(df.columns)


def deduplicated(kind: str, df: DataFrame, order: Column) -> DataFrame:
    keys, which = KEYS[kind]
    return one_of_each(df, keys, order, which)


def news_key(url: str = "url", title: str = "title", published: str = "published_at", source: str = "source") -> Column:
    """The url, else a hash of title, time and source."""
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.sha2(F.concat_ws("|", title, F.col(published).cast("string"), source), 256))


def grouped(df: DataFrame, key: str, ids: str) -> DataFrame:
    """How many records a group has, and its smallest and largest id; the records stay rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ids).alias("first_id"), F.max(ids).alias("last_id"))


def titles_containing(df: DataFrame, phrase: str, title: str = "title") -> DataFrame:
    return df.where(F.contains(F.lower(title), F.lit(phrase.lower())))


def validated_bars(bars: DataFrame, *ids: str) -> DataFrame:
    """One row for each rule that a bar breaks."""
    any_below = F.least("open", "high", "low", "close") <= 0
    rules = {
        "non_positive_price": any_below,
        "high_below_low": F.col("high") < F.col("low"),
        "open_above_high": F.col("open") > F.col("high"),
        "open_below_low": F.col("open") < F.col("low"),
        "close_above_high": F.col("close") > F.col("high"),
        "close_below_low": F.col("close") < F.col("low"),
        "negative_volume": F.col("volume") < 0,
        "delivery_out_of_range": ~F.col("delivery_percent").between(0, 100),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return bars.select(*ids, F.explode(broken).alias("rule"))


def price_conflicts(prices: DataFrame, keys: tuple[str, ...], tolerance: float = 1e-4) -> DataFrame:
    """Keys with two or more closes that differ by more than ``tolerance`` of the largest."""
    g = prices.where("close IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max("close") - F.min("close")).alias("spread"), F.max(F.abs("close")).alias("largest")
    )
    return g.where((F.col("n") >= 2) & (F.try_divide("spread", "largest") > tolerance)).withColumn("relative", F.col("spread") / F.col("largest")).drop("largest")
