"""Further indicators and performance measures, by their public definitions, over bars of many instruments at once."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.columns import TRADING_DAYS, change, days_between, full_window, history, last_rows, ratio
from quantloom.functions.ship import ship_package
from quantloom.operators import alike, scan
from quantloom.operators.market import drawdown_series, prepared, valid_returns

YEAR = TRADING_DAYS**0.5


def bollinger(prices: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    w = history()
    mean = full_window(F.avg("close"), w, window, F.col("close"))
    deviation = full_window(F.stddev_pop("close"), w, window, F.col("close"))
    rows = prepared(prices).select("instrument_id", "ts", "close", mean.alias("middle"), deviation.alias("d")).where("middle IS NOT NULL")
    return rows.select("instrument_id", "ts", "middle", (F.col("middle") + width * F.col("d")).alias("upper"), (F.col("middle") - width * F.col("d")).alias("lower"))


def on_balance_volume(prices: DataFrame) -> DataFrame:
    w = history()
    rows = prepared(prices).withColumn("move", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))
    return rows.select("instrument_id", "ts", F.sum("move").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("obv"))


def stochastic(prices: DataFrame, window: int = 14, smooth: int = 3) -> DataFrame:
    """%K of the close in the range of the last ``window`` rows, %D its mean over ``smooth``, and Williams' %R."""
    w = history()
    high, low = full_window(F.max("high"), w, window, F.col("high")), full_window(F.min("low"), w, window, F.col("low"))
    rows = prepared(prices).select("instrument_id", "ts", "close", high.alias("h"), low.alias("l")).where("h IS NOT NULL AND l IS NOT NULL")
    rows = rows.withColumn("k", ratio(F.col("close") - F.col("l"), F.col("h") - F.col("l")) * 100)
    return rows.select("instrument_id", "ts", "k", full_window(F.avg("k"), w, smooth, F.col("k")).alias("d"), (F.col("k") - 100).alias("williams_r"))


def true_range(prices: DataFrame, window: int = 14) -> DataFrame:
    """Mean of the true range over full windows (the simple mean, not the recursive one)."""
    w = history()
    prev = F.lag("close").over(w)
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    rows = prepared(prices).select("instrument_id", "ts", span.alias("tr"))
    return rows.withColumn("atr", full_window(F.avg("tr"), w, window, F.col("tr"))).where("atr IS NOT NULL")


def directional_movement(prices: DataFrame, n: int = 14) -> DataFrame:
    """Average true range, directional indicators and ADX over ``n`` rows, all by Wilder's recursive smoothing seeded by the mean;
    ADX is null until it is defined."""
    rows = scan.blocked(prepared(prices).select("instrument_id", "ts", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close"))))
    rows = rows.withColumns({f"_was_{c}": F.lag(c).over(history()) for c in ("high", "low", "close")})
    was = lambda c: F.col(f"_was_{c}")
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was("close")), F.abs(F.col("low") - was("close")))
    up, down = F.col("high") - was("high"), was("low") - F.col("low")
    moves = {"atr": span, "plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)}
    rows = scan.smoothed(rows, [scan.Smoothing(name, value, n, scan.wilder(n), skip=1) for name, value in moves.items()])
    rows = rows.withColumn("plus_di", F.try_divide(100 * F.col("plus"), "atr")).withColumn("minus_di", F.try_divide(100 * F.col("minus"), "atr"))
    both = F.col("plus_di") + F.col("minus_di")
    rows = rows.withColumn("_dx", F.when(both == 0, 0.0).otherwise(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both))
    rows = scan.smoothed(rows, [scan.Smoothing("adx", F.col("_dx"), n, scan.wilder(n), skip=n)])
    return rows.where("atr IS NOT NULL").select("instrument_id", "ts", "atr", "plus_di", "minus_di", "adx")


def moving_averages(prices: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """(instrument_id, ts, window, value): simple means of the close over full windows."""
    w = history()
    means = F.array(*(F.struct(F.lit(n).alias("window"), full_window(F.avg("close"), w, n, F.col("close")).alias("value")) for n in windows))
    rows = prepared(prices).select("instrument_id", "ts", means.alias("m"))
    return rows.select("instrument_id", "ts", F.inline("m")).where("value IS NOT NULL")


def text_parts(texts: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, part, text): a text in parts of ``size`` characters, each beginning ``overlap`` before the end of the last; empty
    and null texts have none."""
    text, step = F.col(text_col), size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step)))
    rows = texts.select(F.col(id_col), text.alias("_text"), F.posexplode(starts).alias("part", "at"))
    return rows.select(id_col, "part", F.substring("_text", F.col("at") + 1, F.lit(size)).alias(text_col))


def performance(prices: DataFrame) -> DataFrame:
    """Growth a year, Sharpe, Sortino, Calmar, moments, value at risk and shortfall at 5 %, ulcer index; no risk-free rate."""
    r = valid_returns(prices)
    rank = r.withColumn("k", F.row_number().over(Window.partitionBy("instrument_id").orderBy("r", "ts")))
    size = r.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))
    tail = rank.join(size, "instrument_id").where(F.col("k") <= F.greatest(F.floor(F.col("n") * 0.05), F.lit(1)))
    tail = tail.groupBy("instrument_id").agg(F.max("r").alias("value_at_risk"), F.avg("r").alias("expected_shortfall"))
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)))
    g = r.groupBy("instrument_id").agg(
        (F.avg("r") / F.stddev_samp("r") * YEAR).alias("sharpe"), (F.try_divide(F.avg("r"), down) * YEAR).alias("sortino"), (F.stddev_samp("r") * YEAR).alias("volatility"),
        F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"),
    )
    days = days_between(F.max("ts"), F.min("ts"))
    d = drawdown_series(prices).groupBy("instrument_id").agg(
        F.when((days > 0) & (F.min_by("close", "ts") > 0), F.pow(F.max_by("close", "ts") / F.min_by("close", "ts"), 365.2425 / days) - 1).alias("cagr"),
        F.min("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"),
    )
    return d.join(g, "instrument_id").join(tail, "instrument_id").withColumn("calmar", ratio(F.col("cagr"), F.abs("max_drawdown")))


def regression(aligned: DataFrame) -> DataFrame:
    """Slope, fit and information ratio of returns ``r`` on those of the benchmark ``b`` (from ``aligned_returns``)."""
    return aligned.groupBy("instrument_id").agg(
        F.regr_slope("r", "b").alias("beta"), F.regr_r2("r", "b").alias("r_squared"), (F.avg("excess") / F.stddev_samp("excess") * YEAR).alias("information_ratio")
    )


def recent_volatility(prices: DataFrame, days: int = 60, window: int = 30) -> DataFrame:
    """Deviation of the last ``days`` returns, the same a year, and the share of rolling deviations at or below it."""
    order = Window.partitionBy("instrument_id").orderBy(F.col("ts").desc())
    r = valid_returns(prices).withColumn("back", F.row_number().over(order)).where(F.col("back") <= days)
    w = last_rows(history(), window)
    r = r.withColumn("rolling", F.when(F.count("r").over(w) == window, F.stddev_samp("r").over(w)))
    r = r.withColumn("daily", F.stddev_samp("r").over(Window.partitionBy("instrument_id")))
    g = r.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), F.first("daily").alias("daily_volatility"), (F.first("daily") * YEAR).alias("annualised_volatility"), (F.avg((F.col("rolling") <= F.col("daily")).cast("int")) * 100).alias("percentile"))
    return g.where("n >= 2")


def position_limit(volatility: DataFrame, correlation: DataFrame, base: float = 0.20) -> DataFrame:
    """The share of a portfolio that an instrument may take: less for volatile ones, scaled by mean correlation."""
    # fixed values: steps of volatility and correlation, and what they allow
    v, c = F.col("annualised_volatility"), F.col("mean_correlation")
    share = F.when(v < 0.15, base * 1.25).when(v < 0.30, base * (1 - (v - 0.15) * 0.5)).when(v < 0.50, base * (0.75 - (v - 0.30) * 0.5)).otherwise(base * 0.5)
    scale = F.when(c >= 0.8, 0.70).when(c >= 0.6, 0.85).when(c >= 0.4, 1.0).when(c >= 0.2, 1.05).when(c < 0.2, 1.10).otherwise(1.0)
    rows = volatility.join(correlation.select("instrument_id", "mean_correlation"), "instrument_id", "left")
    return rows.select("instrument_id", share.alias("volatility_limit"), scale.alias("correlation_multiplier"), (share * scale).alias("limit"), change(share * scale, F.lit(base)).alias("against_base"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, blocks: int = 64, most: int = 100_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` vectors most alike by cosine, for a stated set of queries.

    Vectors, in ``blocks`` blocks or as many more as keep them small, meet the queries, of which at most ``most`` are in a part:
    each meeting is one group of a shuffle and keeps its own best ``k`` of a query before the blocks' winners meet. No task
    sees all pairs of a query, and nothing is broadcast. The similarity with a zero vector is NaN, which ranks first; where a
    vector or a component is null or lengths differ it is null, which ranks last."""
    ship_package(queries.sparkSession)
    parts = max(-(-queries.count() // min(most, alike.QUERIES)), 1)
    blocks = max(-(-vectors.count() // alike.VECTORS), blocks)

    def side(df: DataFrame, own: str, n: int, other: str, copies: int) -> GroupedData:
        e = F.col("embedding").cast("array<double>")
        rows = df.where("vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), F.when(F.forall(e, lambda x: x.isNotNull()), e).alias("e"))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).groupBy("block", "part")

    fields = [("query_id", queries.schema["vec_id"].dataType), ("vec_id", vectors.schema["vec_id"].dataType), ("similarity", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    met = side(queries, "part", parts, "block", blocks).cogroup(side(vectors, "block", blocks, "part", parts))
    pairs = met.applyInArrow(functools.partial(alike.best, k, schema), schema).withColumn("similarity", F.round("similarity", 9))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
