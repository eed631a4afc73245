"""Queries of the market operators over supplier-day bars."""

from __future__ import annotations

from quantloom.operators import candles, market
from quantloom.plans.catalog import query
from quantloom.sources.driver_tables import BARS_SQL, BENCHMARK_SQL, bars, benchmark

B = f"WITH {BARS_SQL}"
#: Rows with the close before them, and returns where both closes are positive.
PAIRS = f"""{B}, p AS (
  SELECT *, lag(close) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM bars WHERE ts IS NOT NULL AND close IS NOT NULL
  WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
)"""
RETURNS = f"""{PAIRS}, r AS (SELECT *, close / prev - 1 AS r FROM p WHERE prev > 0 AND close > 0)"""


@query(
    "mkt_01_simple_return",
    f"{PAIRS} SELECT instrument_id, ts, close / prev - 1 AS value FROM p WHERE prev IS NOT NULL AND prev <> 0",
    "value",
)
def mkt_01(spark, d):
    return market.simple_return(bars(spark, d))


@query(
    "mkt_02_return_summary",
    f"""{PAIRS} SELECT instrument_id, count(*) AS n, count(CASE WHEN prev <> 0 THEN 1 END) AS n_returns,
    arg_max(close, ts) / arg_min(close, ts) - 1 AS cumulative, avg(close / nullif(prev, 0) - 1) AS mean_return,
    max(close / nullif(prev, 0) - 1) AS best, min(close / nullif(prev, 0) - 1) AS worst FROM p GROUP BY 1""",
    "cumulative mean_return best worst",
)
def mkt_02(spark, d):
    return market.return_summary(bars(spark, d))


@query(
    "mkt_03_returns",
    f"""{RETURNS} SELECT instrument_id, ts, r AS return_1p, ln(close / prev) AS log_return_1p,
    exp(sum(ln(1 + r)) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS cumulative_return FROM r""",
    "return_1p log_return_1p cumulative_return",
)
def mkt_03(spark, d):
    return market.returns(bars(spark, d))


_AT = ", ".join(f"max(CASE WHEN back = 0 THEN close END) / max(CASE WHEN back = {k} AND close > 0 THEN close END) - 1 AS return_{k}" for k in market.HORIZONS)


@query(
    "mkt_04_return_horizons",
    f"""{B}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM bars),
    g AS (SELECT instrument_id, count(*) AS n, {_AT}, arg_max(close, ts) AS z, arg_min(close, ts) AS a,
      date_diff('day', min(ts), max(ts))::DOUBLE AS span_days FROM k GROUP BY 1)
    SELECT instrument_id, n, {", ".join(f"return_{k}" for k in market.HORIZONS)}, CASE WHEN a > 0 THEN z / a - 1 END AS cumulative, span_days,
    CASE WHEN span_days >= 365 AND a > 0 THEN pow(z / a, 365.2425 / span_days) - 1 END AS annualised FROM g""",
    " ".join(f"return_{k}" for k in market.HORIZONS) + " cumulative span_days annualised",
)
def mkt_04(spark, d):
    return market.return_horizons(bars(spark, d))


@query(
    "mkt_05_rolling_volatility",
    f"""{RETURNS}, v AS (SELECT instrument_id, ts, w AS "window",
      CASE w WHEN 20 THEN v20 WHEN 60 THEN v60 ELSE v252 END AS value FROM (
        SELECT instrument_id, ts,
          CASE WHEN count(r) OVER a = 20 THEN stddev_samp(r) OVER a * sqrt(252) END AS v20,
          CASE WHEN count(r) OVER b = 60 THEN stddev_samp(r) OVER b * sqrt(252) END AS v60,
          CASE WHEN count(r) OVER c = 252 THEN stddev_samp(r) OVER c * sqrt(252) END AS v252
        FROM r WINDOW a AS (PARTITION BY instrument_id ORDER BY ts ROWS 19 PRECEDING),
          b AS (PARTITION BY instrument_id ORDER BY ts ROWS 59 PRECEDING), c AS (PARTITION BY instrument_id ORDER BY ts ROWS 251 PRECEDING)
      ) CROSS JOIN (VALUES (20), (60), (252)) AS x(w))
    SELECT * FROM v WHERE value IS NOT NULL""",
    "value",
)
def mkt_05(spark, d):
    return market.rolling_volatility(bars(spark, d))


@query(
    "mkt_06_volatility_summary",
    f"""{RETURNS}, s AS (SELECT instrument_id, count(*) AS n, stddev_samp(r) * sqrt(252) AS v, avg(r) AS m, list(r ORDER BY r) AS l FROM r GROUP BY 1)
    SELECT instrument_id, n AS n_returns, v AS annualised_volatility, m AS mean_return,
    l[1 + greatest(0, floor(n * 0.05)::BIGINT - 1)] AS p05, l[1 + least(n - 1, floor(n * 0.95)::BIGINT)] AS p95 FROM s""",
    "annualised_volatility mean_return p05 p95",
)
def mkt_06(spark, d):
    return market.volatility_summary(bars(spark, d))


_DD = f"""{B}, x AS (SELECT instrument_id, ts, close, max(close) OVER w AS peak, row_number() OVER w AS i FROM bars
    WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
  dd AS (SELECT x.*, CASE WHEN peak > 0 THEN close / peak - 1 ELSE 0 END AS drawdown,
    max(CASE WHEN close = peak AND (prev_peak IS NULL OR peak > prev_peak) THEN ts END) OVER (PARTITION BY instrument_id ORDER BY ts) AS peak_ts
    FROM (SELECT *, lag(peak) OVER (PARTITION BY instrument_id ORDER BY ts) AS prev_peak FROM x) AS x)"""


@query("mkt_07_drawdown_series", f"{_DD} SELECT instrument_id, ts, peak_ts, drawdown FROM dd", "drawdown")
def mkt_07(spark, d):
    return market.drawdown_series(bars(spark, d)).drop("close", "peak")


@query(
    "mkt_07_drawdown_summary",
    f"""{_DD}, w AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY drawdown, ts) AS k,
      max(ts) OVER (PARTITION BY instrument_id) AS last_ts FROM dd),
    c AS (SELECT instrument_id, arg_max(drawdown, ts) AS current_drawdown FROM dd GROUP BY 1)
    SELECT w.instrument_id, drawdown AS max_drawdown, peak_ts, ts AS trough_ts, date_diff('day', peak_ts, last_ts)::DOUBLE AS time_since_peak_days,
    current_drawdown FROM w JOIN c ON w.instrument_id = c.instrument_id WHERE k = 1""",
    "max_drawdown time_since_peak_days current_drawdown",
)
def mkt_07_summary(spark, d):
    return market.drawdown_summary(bars(spark, d))


@query(
    "mkt_08_moving_averages",
    f"""{B}, m AS (SELECT instrument_id, ts, close, "window", CASE "window" WHEN 20 THEN m20 WHEN 50 THEN m50 ELSE m200 END AS average FROM (
        SELECT instrument_id, ts, close,
          CASE WHEN count(close) OVER a = 20 THEN avg(close) OVER a END AS m20,
          CASE WHEN count(close) OVER b = 50 THEN avg(close) OVER b END AS m50,
          CASE WHEN count(close) OVER c = 200 THEN avg(close) OVER c END AS m200
        FROM bars WINDOW a AS (PARTITION BY instrument_id ORDER BY ts ROWS 19 PRECEDING),
          b AS (PARTITION BY instrument_id ORDER BY ts ROWS 49 PRECEDING), c AS (PARTITION BY instrument_id ORDER BY ts ROWS 199 PRECEDING)
      ) CROSS JOIN (VALUES (20), (50), (200)) AS x("window"))
    SELECT instrument_id, ts, "window", average, close / average - 1 AS distance FROM m WHERE average IS NOT NULL""",
    "average distance",
)
def mkt_08(spark, d):
    return market.moving_averages(bars(spark, d))


@query(
    "mkt_09_liquidity",
    f"""{B}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM bars)
    SELECT instrument_id, "window", count(*) AS n, avg(volume) AS avg_volume, avg(traded_value) AS avg_traded_value,
    avg(delivery_percent) AS avg_delivery_percent, count(volume) / count(*) AS volume_coverage,
    count(traded_value) / count(*) AS value_coverage, count(delivery_percent) / count(*) AS delivery_coverage
    FROM k JOIN (VALUES (20), (60)) AS x("window") ON back < "window" GROUP BY 1, 2""",
    "avg_volume avg_traded_value avg_delivery_percent volume_coverage value_coverage delivery_coverage",
)
def mkt_09(spark, d):
    return market.liquidity(bars(spark, d))


@query(
    "mkt_10_multi_resolution",
    f"""{B}, q AS (
      SELECT instrument_id, ts, close, 'week' AS resolution, isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS period FROM bars
      UNION ALL SELECT instrument_id, ts, close, 'month', strftime(ts, '%Y-%m') FROM bars)
    SELECT instrument_id, resolution, period, arg_max(close, ts) / arg_min(close, ts) - 1 AS period_return, count(*) AS n,
    max(ts) AS period_end FROM q GROUP BY 1, 2, 3""",
    "period_return",
)
def mkt_10(spark, d):
    return market.multi_resolution(bars(spark, d))


def _ema(source: str, out: str, n: int) -> str:
    """Recursive EMA of ``source`` (instrument_id, i, x), seeded by the mean of its first n values."""
    return f"""{out} AS (
      SELECT instrument_id, {n}::BIGINT AS i, avg(x) AS y FROM {source} WHERE i <= {n} GROUP BY 1 HAVING count(*) = {n}
      UNION ALL
      SELECT e.instrument_id, s.i, s.x * (2.0::DOUBLE / {n + 1}) + e.y * (1 - 2.0::DOUBLE / {n + 1})
      FROM {out} AS e JOIN {source} AS s ON s.instrument_id = e.instrument_id AND s.i = e.i + 1
    )"""


@query(
    "mkt_11_technical_indicators",
    f"""WITH RECURSIVE {BARS_SQL}, c AS (
      SELECT instrument_id, ts, close AS x, row_number() OVER w AS i, close - lag(close) OVER w AS move FROM bars
      WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)
    ), {_ema("c", "fast", 12)}, {_ema("c", "slow", 26)},
    macd AS (SELECT f.instrument_id, f.i - 25 AS i, f.y - s.y AS x FROM fast f JOIN slow s ON f.instrument_id = s.instrument_id AND f.i = s.i),
    {_ema("macd", "sig", 9)},
    w AS (
      SELECT instrument_id, 15::BIGINT AS i, avg(greatest(move, 0)) AS gain, avg(greatest(-move, 0)) AS loss FROM c
      WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14
      UNION ALL
      SELECT w.instrument_id, c.i, (w.gain * 13 + greatest(c.move, 0)) / 14, (w.loss * 13 + greatest(-c.move, 0)) / 14
      FROM w JOIN c ON c.instrument_id = w.instrument_id AND c.i = w.i + 1
    )
    SELECT c.instrument_id, c.ts, CASE WHEN w.loss = 0 THEN 100 ELSE 100 - 100 / (1 + w.gain / w.loss) END AS rsi, m.x AS macd,
    s.y AS signal, m.x - s.y AS histogram
    FROM c LEFT JOIN w ON w.instrument_id = c.instrument_id AND w.i = c.i
    LEFT JOIN macd m ON m.instrument_id = c.instrument_id AND m.i = c.i - 25
    LEFT JOIN sig s ON s.instrument_id = c.instrument_id AND s.i = c.i - 25
    WHERE c.instrument_id IN (SELECT instrument_id FROM c GROUP BY 1 HAVING count(*) >= 26)""",
    "rsi macd signal histogram",
)
def mkt_11(spark, d):
    return market.technical_indicators(bars(spark, d))


_WINDOWS = (12, 26, 50, 200)


@query(
    "bkd_01_exponential_averages",
    f"""WITH RECURSIVE {BARS_SQL}, c AS (SELECT instrument_id, ts, close AS x, row_number() OVER (PARTITION BY instrument_id ORDER BY ts) AS i FROM bars),
    {", ".join(_ema("c", f"e{n}", n) for n in _WINDOWS)} """
    + " UNION ALL ".join(f'SELECT c.instrument_id, c.ts, {n} AS "window", e.y AS value FROM e{n} AS e JOIN c ON c.instrument_id = e.instrument_id AND c.i = e.i' for n in _WINDOWS),
    "value",
)
def bkd_01_exponential(spark, d):
    return market.exponential_averages(bars(spark, d), _WINDOWS)


_CANDLE_CONDITIONS = {
    "doji": "body <= 0.1", "hammer": "body <= 0.35 AND up <= 0.1 AND down >= 0.55", "shooting_star": "body <= 0.35 AND up >= 0.55 AND down <= 0.1", "marubozu": "body >= 0.6 AND up <= 0.1 AND down <= 0.1",
    "bullish_engulfing": "s1 = -1 AND s = 1 AND engulfs", "bearish_engulfing": "s1 = 1 AND s = -1 AND engulfs", "bullish_harami": "s1 = -1 AND body1 >= 0.6 AND s = 1 AND inside AND NOT engulfs",
    "bearish_harami": "s1 = 1 AND body1 >= 0.6 AND s = -1 AND inside AND NOT engulfs",
    "morning_star": "s2 = -1 AND body2 >= 0.6 AND body1 <= 0.35 AND below1 AND NOT engulfs1 AND NOT inside1 AND s = 1 AND body > 0.35 AND close > (top2 + bottom2) / 2",
    "evening_star": "s2 = 1 AND body2 >= 0.6 AND body1 <= 0.35 AND above1 AND NOT engulfs1 AND NOT inside1 AND s = -1 AND body > 0.35 AND close < (top2 + bottom2) / 2",
    "three_white_soldiers": "s2 = 1 AND body2 > 0.35 AND s1 = 1 AND body1 > 0.35 AND plain1 AND rises1 AND s = 1 AND body > 0.35 AND plain AND rises",
    "three_black_crows": "s2 = -1 AND body2 > 0.35 AND s1 = -1 AND body1 > 0.35 AND plain1 AND falls1 AND s = -1 AND body > 0.35 AND plain AND falls",
}


@query(
    "bkd_01_candles",
    f"""WITH {BARS_SQL}, b AS (SELECT instrument_id, ts, open, close, greatest(open, close) AS top, least(open, close) AS bottom, sign(close - open) AS s, high - low AS span, high, low FROM bars),
    c AS (SELECT *, CASE WHEN span > 0 THEN (top - bottom) / span ELSE 0 END AS body, CASE WHEN span > 0 THEN (high - top) / span ELSE 0 END AS up, CASE WHEN span > 0 THEN (bottom - low) / span ELSE 0 END AS down FROM b),
    d AS (SELECT *, lag(top) OVER w AS top1, lag(bottom) OVER w AS bottom1, lag(close) OVER w AS close1, lag(top, 2) OVER w AS top2, lag(bottom, 2) OVER w AS bottom2, lag(s) OVER w AS s1, lag(s, 2) OVER w AS s2, lag(body) OVER w AS body1, lag(body, 2) OVER w AS body2
      FROM c WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    e AS (SELECT *, coalesce(top >= top1 AND bottom <= bottom1 AND top - bottom > top1 - bottom1, false) AS engulfs, coalesce(top < top1 AND bottom > bottom1, false) AS inside, coalesce(bottom > top1, false) AS above, coalesce(top < bottom1, false) AS below,
      coalesce(open BETWEEN bottom1 AND top1 AND close > close1, false) AS rises, coalesce(open BETWEEN bottom1 AND top1 AND close < close1, false) AS falls FROM d),
    f AS (SELECT *, NOT (engulfs OR inside OR above OR below) AS plain FROM e),
    g AS (SELECT *, lag(engulfs) OVER w AS engulfs1, lag(inside) OVER w AS inside1, lag(above) OVER w AS above1, lag(below) OVER w AS below1, lag(rises) OVER w AS rises1, lag(falls) OVER w AS falls1, lag(plain) OVER w AS plain1 FROM f WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)) """
    + " UNION ALL ".join(f"SELECT instrument_id, ts, '{name}' AS pattern FROM g WHERE {condition}" for name, condition in _CANDLE_CONDITIONS.items()),
)
def bkd_01_candles(spark, d):
    return candles.candle_patterns(bars(spark, d))


EXCESS = f"""{PAIRS}, {BENCHMARK_SQL}, e AS (
  SELECT p.instrument_id, p.ts, p.close / p.prev - 1 - (b.benchmark_close / q.benchmark_close - 1) AS excess_return_1p
  FROM p JOIN bench b ON b.ts = p.ts JOIN bench q ON q.ts = p.prev_ts WHERE p.prev > 0 AND q.benchmark_close > 0
)"""


@query("mkt_12_relative_performance", f"{EXCESS} SELECT * FROM e", "excess_return_1p")
def mkt_12(spark, d):
    return market.relative_performance(bars(spark, d), benchmark(spark, d))


@query(
    "mkt_12_relative_summary",
    f"""{EXCESS} SELECT instrument_id, avg(excess_return_1p) AS mean_excess, sum(excess_return_1p) AS cumulative_excess,
    arg_max(excess_return_1p, ts) AS latest_excess, count(*) AS n FROM e GROUP BY 1""",
    "mean_excess cumulative_excess latest_excess",
)
def mkt_12_summary(spark, d):
    return market.relative_summary(bars(spark, d), benchmark(spark, d))
