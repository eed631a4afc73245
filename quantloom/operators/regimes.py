"""Descriptive regimes of price histories: multi-horizon state, trend, volatility, extremes, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import TRADING_DAYS, change, history, last_rows
from quantloom.operators.market import latest_first, prepared, valid_returns

LOOKBACKS = (("1y", 252), ("3y", 756), ("5y", 1260), ("10y", 2520))
YEAR = TRADING_DAYS**0.5


def whole_days(end: Column, start: Column) -> Column:
    return F.greatest(F.floor((F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000), F.lit(0)).cast("long")


def midrank(values: Column, latest: Column) -> Column:
    """Percentile 0-100 of ``latest`` among ``values``: those below, and half of those equal."""
    below, equal = (F.sum(F.when(c, 1).otherwise(0)) for c in (values < latest, values == latest))
    return (below + equal / 2) * 100 / F.count(values)


def historical_state(prices: DataFrame, lookbacks: tuple[tuple[str, int], ...] = LOOKBACKS) -> DataFrame:
    """For each lookback (all rows where the history is shorter): span, returns, risk and the deepest fall within it.

    A history is sorted once; its rows are multiplied by the lookbacks only on their way into the sums."""
    w = history()
    so_far, all_rows = (w.rowsBetween(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
    back = F.count(F.lit(1)).over(all_rows) - F.row_number().over(w)
    rows = prepared(prices).select("instrument_id", "ts", "close", F.lag("close").over(w).alias("before"), back.alias("back"))
    peaks = {n: F.max(F.when(F.col("back") < n, F.col("close"))).over(so_far) for _, n in lookbacks}
    rows = rows.select("*", *(peak.alias(f"peak_{n}") for n, peak in peaks.items()))
    before = lambda n: F.when(F.col("back") < n - 1, F.col("before"))
    spans = F.array(*(F.struct(F.lit(name).alias("horizon"), F.lit(n).alias("rows"), before(n).alias("prev"), F.col(f"peak_{n}").alias("peak")) for name, n in lookbacks))
    rows = rows.select("instrument_id", "ts", "close", "back", F.inline(spans)).where("back < rows")
    r = F.when((F.col("prev") > 0) & (F.col("close") > 0), F.col("close") / F.col("prev") - 1)
    rows = rows.withColumn("r", r).withColumn("fall", F.when(F.col("peak") > 0, F.col("close") / F.col("peak") - 1).otherwise(0.0))
    start, end = F.min_by("close", "ts"), F.max_by("close", "ts")
    days = whole_days(F.max("ts"), F.min("ts"))
    return (
        rows.groupBy("instrument_id", "horizon")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            days.alias("calendar_span_days"),
            F.when(start > 0, end / start - 1).alias("cumulative_return"),
            F.when((start > 0) & (end > 0) & (days >= 365), F.pow(end / start, 365.2425 / days) - 1).alias("annualized_return"),
            (F.stddev_samp("r") * YEAR).alias("annualized_volatility"),
            F.avg((F.col("r") > 0).cast("int")).alias("positive_return_fraction"),
            F.max("r").alias("best_period_return"),
            F.min("r").alias("worst_period_return"),
            F.least(F.min("fall"), F.lit(0.0)).alias("maximum_drawdown"),
        )
        .where("observations >= 2")
    )


def historical_percentiles(prices: DataFrame, window: int = 252) -> DataFrame:
    """Mid-rank percentiles of the latest close and of the latest return among the last ``window`` of each."""
    closes = latest_first(prepared(prices)).where(F.col("back") < window)
    closes = closes.withColumn("latest", F.first("close").over(Window.partitionBy("instrument_id").orderBy("back")))
    closes = closes.groupBy("instrument_id").agg(midrank(F.col("close"), F.col("latest")).alias("close_percentile"), F.count(F.lit(1)).alias("n"))
    r = latest_first(valid_returns(prices)).where(F.col("back") < window)
    r = r.withColumn("latest", F.first("r").over(Window.partitionBy("instrument_id").orderBy("back")))
    r = r.groupBy("instrument_id").agg(F.first("latest").alias("latest_return"), midrank(F.col("r"), F.col("latest")).alias("latest_return_percentile"))
    return closes.where("n >= 2").drop("n").join(r, "instrument_id", "left")


def trend_state(prices: DataFrame, short: int = 20, medium: int = 50, long: int = 200, slope: int = 20) -> DataFrame:
    rows = latest_first(prepared(prices)).where(F.col("back") < max(short, medium, long, slope))
    close_at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    enough = lambda n, c: F.when(F.count(F.lit(1)) >= n, c)
    sma = lambda n: enough(n, F.avg(F.when(F.col("back") < n, F.col("close"))))
    steps = lambda n: enough(n, (close_at(0) - close_at(n - 1)) / (n - 1))
    g = rows.groupBy("instrument_id").agg(
        close_at(0).alias("current_close"),
        sma(short).alias("sma_short"), sma(medium).alias("sma_medium"), sma(long).alias("sma_long"),
        steps(slope).alias("short_slope"), steps(long).alias("long_slope"),
    )
    c, m, l, s, t = (F.col(x) for x in ("current_close", "sma_medium", "sma_long", "short_slope", "long_slope"))
    state = (
        F.when(m.isNull() | s.isNull(), "insufficient_history")
        .when((c > m) & (m > l) & (s > 0) & (t >= 0), "strong_up")
        .when((c > m) & (s > 0), "up")
        .when((c < m) & (m < l) & (s < 0) & (t <= 0), "strong_down")
        .when((c < m) & (s < 0), "down")
        .otherwise("neutral")
    )
    return g.select("*", state.alias("state"), *((c > F.col(f"sma_{x}")).alias(f"above_{x}") for x in ("short", "medium", "long")))


def volatility_state(prices: DataFrame, window: int = 20, past: int = 252) -> DataFrame:
    w = last_rows(history(), window)
    rows = valid_returns(prices).withColumn("v", F.when(F.count("r").over(w) == window, F.stddev_samp("r").over(w) * YEAR)).where("v IS NOT NULL")
    rows = latest_first(rows).where(F.col("back") < past)
    rows = rows.withColumn("latest", F.first("v").over(Window.partitionBy("instrument_id").orderBy("back")))
    g = rows.groupBy("instrument_id").agg(
        F.first("latest").alias("current_annualized_volatility"),
        midrank(F.col("v"), F.col("latest")).alias("historical_percentile"),
        F.count(F.lit(1)).alias("history_observations"),
    )
    p = F.col("historical_percentile")
    return g.withColumn("state", F.when(p.isNull(), "unknown").when(p < 20, "low").when(p > 80, "high").otherwise("normal"))


def extremes(prices: DataFrame) -> DataFrame:
    """The highest and lowest close (the earliest of equal ones), the distance from them and days since."""
    high, low = F.min(F.struct(-F.col("close"), "ts")), F.min(F.struct("close", "ts"))
    g = prepared(prices).groupBy("instrument_id").agg(high.alias("h"), low.alias("l"), F.max_by("close", "ts").alias("c"), F.max("ts").alias("t"))
    top = -F.col("h.col1")
    return g.select(
        "instrument_id",
        F.col("h.ts").alias("all_time_high_ts"),
        F.when(top > 0, F.col("c") / top - 1).alias("distance_from_high"),
        whole_days(F.col("t"), F.col("h.ts")).alias("days_since_high"),
        F.col("l.ts").alias("all_time_low_ts"),
        F.when(F.col("l.close") > 0, change(F.col("c"), F.col("l.close"))).alias("distance_from_low"),
        whole_days(F.col("t"), F.col("l.ts")).alias("days_since_low"),
    )


def persistence(prices: DataFrame, ma_window: int = 200) -> DataFrame:
    """Streaks of rising and falling days as islands of equal sign, and how long closes stay above their average."""
    w = history()
    r = valid_returns(prices).withColumn("sign", F.signum("r").cast("int"))
    r = r.withColumn("island", F.sum(F.when(F.col("sign") == F.lag("sign").over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = r.groupBy("instrument_id", "island", "sign").agg(F.count(F.lit(1)).alias("length"))
    longest = lambda s: F.max(F.when(F.col("sign") == s, F.col("length")).otherwise(0))
    days = lambda s: F.sum(F.when(F.col("sign") == s, F.col("length")).otherwise(0)) / F.sum("length")
    last = F.max_by(F.struct("sign", "length"), "island")
    streaks = islands.groupBy("instrument_id").agg(
        days(1).alias("positive_return_fraction"), days(-1).alias("negative_return_fraction"),
        F.when(last["sign"] == 1, last["length"]).otherwise(0).alias("current_positive_streak"),
        F.when(last["sign"] == -1, last["length"]).otherwise(0).alias("current_negative_streak"),
        longest(1).alias("maximum_positive_streak"), longest(-1).alias("maximum_negative_streak"),
    )
    m = prepared(prices).withColumn("ma", F.when(F.count("close").over(last_rows(w, ma_window)) == ma_window, F.avg("close").over(last_rows(w, ma_window))))
    above = m.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("ma").isNotNull(), (F.col("close") > F.col("ma")).cast("int"))).alias("fraction_above_ma"),
        F.max_by(F.col("close") > F.col("ma"), "ts").alias("current_above_ma"),
    )
    return above.where("n >= 2").drop("n").join(streaks, "instrument_id", "left")
