"""Market operators over price bars (instrument_id, ts, open, high, low, close, volume, traded_value, delivery_percent).

All work on all instruments at once. Operators that need history share one window specification, so Spark shuffles
bars once by instrument; only the recursive indicators run in Python, one instrument's history at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import TRADING_DAYS, change, compounded, days_between, history, last_rows
from quantloom.operators import scan

HORIZONS = (1, 5, 21, 63, 126, 252)


def prepared(prices: DataFrame) -> DataFrame:
    """Rows with an instant and a close, the only ones that count."""
    return prices.where(F.col("ts").isNotNull() & F.col("close").isNotNull())


def with_previous(prices: DataFrame) -> DataFrame:
    w = history()
    return prepared(prices).withColumn("prev", F.lag("close").over(w)).withColumn("prev_ts", F.lag("ts").over(w))


def valid_returns(prices: DataFrame) -> DataFrame:
    """Returns between neighbouring rows that both have positive prices."""
    return with_previous(prices).where("prev > 0 AND close > 0").withColumn("r", F.col("close") / F.col("prev") - 1)


def simple_return(prices: DataFrame) -> DataFrame:
    return with_previous(prices).where("prev IS NOT NULL AND prev <> 0").select(
        "instrument_id", "ts", (F.col("close") / F.col("prev") - 1).alias("value")
    )


def zero_denominators(prices: DataFrame) -> DataFrame:
    """Issues of ``simple_return``: rows whose previous close is zero."""
    return with_previous(prices).where("prev = 0").select("instrument_id", "ts", F.lit("zero_denominator").alias("code"))


def return_summary(prices: DataFrame) -> DataFrame:
    r = F.when(F.col("prev") != 0, F.col("close") / F.col("prev") - 1)
    return with_previous(prices).groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(r).alias("n_returns"),
        change(F.max_by("close", "ts"), F.min_by("close", "ts")).alias("cumulative"),
        F.avg(r).alias("mean_return"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    )


def returns(prices: DataFrame) -> DataFrame:
    so_far = history().rowsBetween(Window.unboundedPreceding, 0)
    return valid_returns(prices).select(
        "instrument_id",
        "ts",
        F.col("r").alias("return_1p"),
        F.log(F.col("close") / F.col("prev")).alias("log_return_1p"),
        (F.exp(F.sum(F.log1p("r")).over(so_far)) - 1).alias("cumulative_return"),
    )


def latest_first(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``back``: 0 for the latest row of each key, 1 for the one before it, and so on."""
    keys = keys or ("instrument_id",)
    return df.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc())) - 1)


def return_horizons(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    days = days_between(F.max("ts"), F.min("ts"))
    total = F.max_by("close", "ts") / F.min_by("close", "ts")
    positive = lambda x: F.when(x > 0, x)
    return latest_first(prepared(prices)).groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(change(at(0), positive(at(k))).alias(f"return_{k}") for k in horizons),
        F.when(F.min_by("close", "ts") > 0, total - 1).alias("cumulative"),
        days.alias("span_days"),
        F.when((days >= 365) & (F.min_by("close", "ts") > 0), F.pow(total, 365.2425 / days) - 1).alias("annualised"),
    )


def rolling_volatility(prices: DataFrame, windows: tuple[int, ...] = (20, 60, 252)) -> DataFrame:
    """Annualised sample deviation of the last w returns, for full windows; at the return's own instant.

    Windows are differences of running sums of the returns, less their first one against cancellation, and of their squares:
    each row is read once, however long the windows are."""
    w = history()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = valid_returns(prices).withColumn("x", F.col("r") - F.first("r").over(so_far))
    df = df.select("instrument_id", "ts", F.row_number().over(w).alias("k"), F.sum("x").over(so_far).alias("s1"), F.sum(F.col("x") * F.col("x")).over(so_far).alias("s2"))
    for n in windows:
        one, two = (F.col(c) - F.lag(c, n, 0.0).over(w) for c in ("s1", "s2"))
        spread = F.greatest(two - one * one / n, F.lit(0.0)) / (n - 1)
        df = df.withColumn(f"v{n}", F.when(F.col("k") >= n, F.sqrt(spread) * F.sqrt(F.lit(float(TRADING_DAYS)))))
    rows = F.array(*(F.struct(F.lit(n).alias("window"), F.col(f"v{n}").alias("value")) for n in windows))
    return df.select("instrument_id", "ts", F.inline(rows)).where("value IS NOT NULL")


def volatility_summary(prices: DataFrame) -> DataFrame:
    """Percentiles by position in the sorted returns, without interpolation."""
    by_rank = Window.partitionBy("instrument_id").orderBy("r", "ts")
    ranked = valid_returns(prices).withColumn("k", F.row_number().over(by_rank) - 1)
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instrument_id")))
    low = F.greatest(F.lit(0), F.floor(F.col("n") * 0.05) - 1)
    high = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return ranked.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n_returns"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annualised_volatility"),
        F.avg("r").alias("mean_return"),
        F.max(F.when(F.col("k") == low, F.col("r"))).alias("p05"),
        F.max(F.when(F.col("k") == high, F.col("r"))).alias("p95"),
    )


def drawdown_series(prices: DataFrame) -> DataFrame:
    so_far = history().rowsBetween(Window.unboundedPreceding, 0)
    df = prepared(prices).withColumn("peak", F.max("close").over(so_far))
    df = df.withColumn("peak_ts", F.min_by("ts", F.struct(-F.col("close"), "ts")).over(so_far))
    return df.select(
        "instrument_id", "ts", "close", "peak", "peak_ts",
        F.when(F.col("peak") > 0, F.col("close") / F.col("peak") - 1).otherwise(0.0).alias("drawdown"),
    )


def drawdown_summary(prices: DataFrame) -> DataFrame:
    """The deepest fall (the first of equal ones), its peak and trough, days since that peak, and the fall now."""
    worst = F.min(F.struct("drawdown", "ts", "peak_ts"))
    return (
        drawdown_series(prices)
        .groupBy("instrument_id")
        .agg(worst.alias("w"), F.max("ts").alias("last_ts"), F.max_by("drawdown", "ts").alias("current_drawdown"))
        .select(
            "instrument_id",
            F.col("w.drawdown").alias("max_drawdown"),
            F.col("w.peak_ts").alias("peak_ts"),
            F.col("w.ts").alias("trough_ts"),
            days_between(F.col("last_ts"), F.col("w.peak_ts")).alias("time_since_peak_days"),
            "current_drawdown",
        )
    )


def moving_averages(prices: DataFrame, windows: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    w = history()
    df = prepared(prices)
    for n in windows:
        df = df.withColumn(f"m{n}", F.when(F.count("close").over(last_rows(w, n)) == n, F.avg("close").over(last_rows(w, n))))
    rows = F.array(*(F.struct(F.lit(n).alias("window"), F.col(f"m{n}").alias("average")) for n in windows))
    df = df.select("instrument_id", "ts", "close", F.inline(rows)).where("average IS NOT NULL")
    return df.select("instrument_id", "ts", "window", "average", change(F.col("close"), F.col("average")).alias("distance"))


def liquidity(prices: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    recent = latest_first(prepared(prices)).where(F.col("back") < max(windows))
    recent = recent.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).where("back < window")
    part = lambda c: F.count(c) / F.count(F.lit(1))
    return recent.groupBy("instrument_id", "window").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("volume").alias("avg_volume"),
        F.avg("traded_value").alias("avg_traded_value"),
        F.avg("delivery_percent").alias("avg_delivery_percent"),
        part("volume").alias("volume_coverage"),
        part("traded_value").alias("value_coverage"),
        part("delivery_percent").alias("delivery_coverage"),
    )


def multi_resolution(prices: DataFrame) -> DataFrame:
    """Returns from the first to the last close of each ISO week and each month."""
    week = F.concat_ws("-W", F.extract(F.lit("YEAROFWEEK"), "ts"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    period = F.array(
        F.struct(F.lit("week").alias("resolution"), week.alias("period")),
        F.struct(F.lit("month").alias("resolution"), F.date_format("ts", "yyyy-MM").alias("period")),
    )
    rows = prepared(prices).select("instrument_id", "ts", "close", F.inline(period))
    return rows.groupBy("instrument_id", "resolution", "period").agg(
        change(F.max_by("close", "ts"), F.min_by("close", "ts")).alias("period_return"),
        F.count(F.lit(1)).alias("n"),
        F.max("ts").alias("period_end"),
    )


def technical_indicators(prices: DataFrame) -> DataFrame:
    """RSI(14) by Wilder and MACD(12, 26, 9), for instruments with at least 26 rows; null until they are defined."""
    rows = scan.blocked(prepared(prices).select("instrument_id", "ts", F.col("close").cast("double").alias("close")))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instrument_id"))).where("n >= 26").drop("n")
    rows = rows.withColumn("move", F.col("close") - F.lag("close").over(history()))
    move = F.col("move")
    means = [
        scan.Smoothing("gain", F.greatest(move, F.lit(0.0)), 14, scan.wilder(14), skip=1),
        scan.Smoothing("loss", F.greatest(-move, F.lit(0.0)), 14, scan.wilder(14), skip=1),
        scan.Smoothing("fast", F.col("close"), 12, scan.ema(12)),
        scan.Smoothing("slow", F.col("close"), 26, scan.ema(26)),
    ]
    rows = scan.smoothed(rows, means).withColumn("macd", F.col("fast") - F.col("slow"))
    rows = scan.smoothed(rows, [scan.Smoothing("signal", F.col("macd"), 9, scan.ema(9), skip=25)])
    rsi = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    return rows.select("instrument_id", "ts", rsi.alias("rsi"), "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram"))


def exponential_averages(prices: DataFrame, windows: tuple[int, ...] = (12, 26, 50, 200)) -> DataFrame:
    """(instrument_id, ts, window, value): exponential means of the close, seeded by the plain mean of their first rows."""
    rows = scan.blocked(prepared(prices).select("instrument_id", "ts", F.col("close").cast("double").alias("close")))
    rows = scan.smoothed(rows, [scan.Smoothing(f"ema{n}", F.col("close"), n, scan.ema(n)) for n in windows])
    each = F.array(*(F.struct(F.lit(n).alias("window"), F.col(f"ema{n}").alias("value")) for n in windows))
    return rows.select("instrument_id", "ts", F.inline(each)).where("value IS NOT NULL")


def relative_performance(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Excess return on each day on which the benchmark has this and the previous day of the instrument."""
    b = benchmark.select(F.col("ts").alias("b_ts"), "benchmark_close")
    p = benchmark.select(F.col("ts").alias("p_ts"), F.col("benchmark_close").alias("benchmark_prev"))
    rows = with_previous(prices).where("prev > 0")
    rows = rows.join(b, F.col("ts") == F.col("b_ts")).join(p, F.col("prev_ts") == F.col("p_ts")).where("benchmark_prev > 0")
    excess = (F.col("close") / F.col("prev") - 1) - (F.col("benchmark_close") / F.col("benchmark_prev") - 1)
    return rows.select("instrument_id", "ts", excess.alias("excess_return_1p"))


def relative_summary(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    return relative_performance(prices, benchmark).groupBy("instrument_id").agg(
        F.avg("excess_return_1p").alias("mean_excess"),
        F.sum("excess_return_1p").alias("cumulative_excess"),
        F.max_by("excess_return_1p", "ts").alias("latest_excess"),
        F.count(F.lit(1)).alias("n"),
    )


def compounded_horizon(r, horizon: int):
    return F.when(F.count(F.when(F.col("back") < horizon, r)) == horizon, compounded(F.when(F.col("back") < horizon, r)))


