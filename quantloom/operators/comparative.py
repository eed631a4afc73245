"""Instruments against a benchmark, against peers, and against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import TRADING_DAYS, compounded, ratio
from quantloom.operators.market import latest_first, prepared, with_previous

YEAR = TRADING_DAYS**0.5


def aligned_returns(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns of both sides on days whose day and previous day the benchmark has too; all four prices positive.

    The benchmark has one row a day, so both joins are on days and neither side is expanded."""
    b = benchmark.select(F.col("ts").alias("b_ts"), F.col("benchmark_close").alias("b1"))
    p = benchmark.select(F.col("ts").alias("p_ts"), F.col("benchmark_close").alias("b0"))
    rows = with_previous(prices).where("prev > 0 AND close > 0")
    rows = rows.join(b, F.col("ts") == F.col("b_ts")).join(p, F.col("prev_ts") == F.col("p_ts")).where("b1 > 0 AND b0 > 0")
    rows = rows.select("instrument_id", "ts", (F.col("close") / F.col("prev") - 1).alias("r"), (F.col("b1") / F.col("b0") - 1).alias("b"))
    return rows.withColumn("excess", F.col("r") - F.col("b"))


def recent(value: Column, n: int) -> Column:
    """Compounded over the last ``n`` rows (``back`` below n); null where there are fewer."""
    inside = F.when(F.col("back") < n, value)
    return F.when(F.count(inside) == n, compounded(inside))


def benchmark_comparison(prices: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = (21, 63, 126, 252)) -> DataFrame:
    deviation = F.stddev_samp("excess")
    rows = latest_first(aligned_returns(prices, benchmark))
    found = rows.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("aligned_observations"),
        ratio(F.covar_samp("r", "b"), F.stddev_samp("r") * F.stddev_samp("b")).alias("correlation"),
        ratio(F.covar_samp("r", "b"), F.var_samp("b")).alias("beta"),
        (deviation * YEAR).alias("tracking_error"),
        (ratio(F.avg("excess"), deviation) * YEAR).alias("information_ratio"),
        *(recent(F.col("r"), n).alias(f"instrument_return_{n}p") for n in horizons),
        *(recent(F.col("b"), n).alias(f"benchmark_return_{n}p") for n in horizons),
    )
    return found.select("*", *((F.col(f"instrument_return_{n}p") - F.col(f"benchmark_return_{n}p")).alias(f"excess_return_{n}p") for n in horizons))


def horizon_returns(prices: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(instrument_id, horizon, value): the last close over the close ``horizon`` rows before; null if there is none."""
    at = lambda k: F.max(F.when((F.col("back") == k) & (F.col("close") > 0), F.col("close")))
    rows = latest_first(prepared(prices)).where(F.col("back") <= max(horizons))
    wide = rows.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), at(0).alias("last"), *(at(k).alias(f"c{k}") for k in horizons))
    pairs = F.array(*(F.struct(F.lit(k).alias("horizon"), (F.col("last") / F.col(f"c{k}") - 1).alias("value")) for k in horizons))
    return wide.where("n >= 2").select("instrument_id", F.inline(pairs))


def peer_table(given: DataFrame) -> DataFrame:
    """(instrument_id, peer_id) from lists of peers (instrument_id, peers): each once, nobody is its own peer."""
    rows = given.select("instrument_id", F.explode(F.array_distinct("peers")).alias("peer_id"))
    return rows.where("peer_id IS NOT NULL AND peer_id <> instrument_id").distinct()


def peer_returns(prices: DataFrame, peers: DataFrame, horizons: tuple[int, ...] = (1, 21, 63, 252)) -> DataFrame:
    """Each instrument's horizon return among those of its peers; statistics only where both sides have one.

    The peer join is on returns, one row for each instrument and horizon, not on histories."""
    own = horizon_returns(prices, horizons)
    other = own.select(F.col("instrument_id").alias("peer_id"), F.col("horizon").alias("h"), F.col("value").alias("peer"))
    rows = own.join(peers, "instrument_id").join(other, ["peer_id"]).where("horizon = h")
    both = F.col("value").isNotNull()
    peer = F.when(both, F.col("peer"))
    found = rows.groupBy("instrument_id", "horizon").agg(
        F.max("value").alias("target_return"),
        F.count("peer").alias("peer_observations"),
        F.avg(peer).alias("peer_mean"),
        F.percentile(peer, 0.5).alias("peer_median"),
        F.min(peer).alias("peer_min"),
        F.max(peer).alias("peer_max"),
        F.avg(F.when(peer.isNotNull(), (F.col("peer") <= F.col("value")).cast("int"))).alias("target_percentile"),
        F.stddev_samp(peer).alias("deviation"),
    )
    return found.select(
        "*",
        (F.col("target_return") - F.col("peer_median")).alias("excess_vs_peer_median"),
        ratio(F.col("target_return") - F.col("peer_mean"), F.col("deviation")).alias("peer_zscore"),
    ).drop("deviation")


def group_returns(prices: DataFrame, groups: DataFrame, horizons: tuple[int, ...] = (1, 21, 63, 252)) -> DataFrame:
    """``peer_returns`` where the peers of an instrument are the others of its group (instrument_id, group).

    Sums, counts and places in the sorted returns of a group give the statistics of all but one, so that no pair of
    instruments is ever made. An instrument alone in its group has no row."""
    own = horizon_returns(prices, horizons).join(groups.select("instrument_id", "group"), "instrument_id")
    key = ("group", "horizon")
    by_value = Window.partitionBy(*key).orderBy("value")
    there = own.where("value IS NOT NULL")
    ranked = there.withColumn("k", F.row_number().over(by_value)).withColumn("upto", F.count(F.lit(1)).over(by_value.rangeBetween(Window.unboundedPreceding, 0)))
    size = there.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    middle = F.floor(F.col("n") / 2)
    at = lambda place, name: F.max(F.when(F.col("k") == place, F.col("value"))).alias(name)
    center = F.avg("value").over(Window.partitionBy(*key))
    # places around the middle: whichever row is left out, the median of the rest is one or two of these
    told = ranked.withColumn("x", F.col("value") - center).join(size, list(key)).groupBy(*key).agg(
        F.max("n").alias("n"), F.sum("value").alias("total"), F.sum("x").alias("x1"), F.sum(F.col("x") * F.col("x")).alias("x2"), F.avg("value").alias("center"),
        at(1, "low1"), at(2, "low2"), at(F.col("n"), "high1"), at(F.col("n") - 1, "high2"),
        *(at(middle + d, f"m{d}") for d in (0, 1, 2)),
    )
    members = own.groupBy(*key).agg(F.count(F.lit(1)).alias("members"))
    rows = own.join(members, list(key)).where("members > 1").join(told, list(key), "left")
    rows = rows.join(ranked.select("instrument_id", "horizon", "k", "upto"), ["instrument_id", "horizon"], "left")
    v, n, k, x = F.col("value"), F.col("n"), F.col("k"), F.col("value") - F.col("center")
    peers, there_too = n - 1, v.isNotNull() & (n > 1)
    half = F.floor(n / 2)
    # the i-th of the others is the i-th of all before the row's own place and the next one from there on
    other = lambda i: F.get(F.array("m0", "m1", "m2"), (i + F.when(i >= k, 1).otherwise(0) - half).cast("int"))
    median = F.when(peers % 2 == 1, other(F.floor((peers + 1) / 2))).otherwise((other(F.floor(peers / 2)) + other(F.floor(peers / 2) + 1)) / 2)
    x1 = F.col("x1") - x
    variance = F.greatest(F.col("x2") - x * x - x1 * x1 / peers, F.lit(0.0)) / (peers - 1)
    deviation = F.when(there_too & (peers > 1), F.sqrt(variance))
    mean = F.when(there_too, (F.col("total") - v) / peers)
    found = rows.select(
        "instrument_id", "horizon", v.alias("target_return"), F.coalesce(n - F.when(v.isNotNull(), 1).otherwise(0), F.lit(0)).alias("peer_observations"), mean.alias("peer_mean"),
        F.when(there_too, median).alias("peer_median"), F.when(there_too, F.when(k == 1, F.col("low2")).otherwise(F.col("low1"))).alias("peer_min"),
        F.when(there_too, F.when(k == n, F.col("high2")).otherwise(F.col("high1"))).alias("peer_max"), F.when(there_too, (F.col("upto") - 1) / peers).alias("target_percentile"), deviation.alias("deviation"),
    )
    return found.select(
        "*",
        (F.col("target_return") - F.col("peer_median")).alias("excess_vs_peer_median"),
        ratio(F.col("target_return") - F.col("peer_mean"), F.col("deviation")).alias("peer_zscore"),
    ).drop("deviation")


def correlation_summary(prices: DataFrame, top: int = 3, least_days: int = 5) -> DataFrame:
    """Pairwise correlation of daily returns within groups of instruments (column ``group``), over the days that all
    members of the group have; for each instrument the mean and largest correlation and the ``top`` partners.

    Returns become one standardised vector for each instrument, as long as the calendar; pairs of instruments meet as
    vectors, not day by day. The largest correlations need every pair of a group, so groups should be baskets."""
    r = with_previous(prices.drop("group")).where("prev > 0").select("instrument_id", "ts", (F.col("close") / F.col("prev") - 1).alias("r"))
    r = r.join(prices.select("instrument_id", "group").distinct(), "instrument_id")
    size = r.groupBy("group").agg(F.countDistinct("instrument_id").alias("members"))
    days = r.groupBy("group", "ts").agg(F.count(F.lit(1)).alias("present")).join(size, "group").where("present = members AND members >= 2")
    r = r.join(days.select("group", "ts"), ["group", "ts"])
    series = r.groupBy("group", "instrument_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "r"))), lambda x: x["r"]).alias("r"), F.avg("r").alias("mean"))
    series = series.where(F.size("r") >= least_days).withColumn("x", F.transform("r", lambda x: x - F.col("mean")))
    series = series.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)))
    series = series.select("group", "instrument_id", F.transform("x", lambda x: F.try_divide(x, F.col("length"))).alias("x"))
    other = series.select("group", F.col("instrument_id").alias("other"), F.col("x").alias("y"))
    correlation = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = series.join(other, "group").where("instrument_id <> other").select("instrument_id", "other", correlation.alias("correlation"))
    order = Window.partitionBy("instrument_id").orderBy(F.round("correlation", 9).desc(), "other")
    pairs = pairs.withColumn("k", F.row_number().over(order))
    return pairs.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("partners"),
        F.avg("correlation").alias("mean_correlation"),
        F.max("correlation").alias("max_correlation"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= top, F.struct("k", "other")))), lambda x: x["other"].cast("string")), ",").alias("most_correlated"),
    )
