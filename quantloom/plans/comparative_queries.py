"""Queries of the comparative operators and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import comparative, regimes
from quantloom.plans.catalog import query
from quantloom.plans.market_queries import PAIRS, RETURNS, B
from quantloom.sources.driver_tables import BENCHMARK_SQL, bars, benchmark, peers, read

ALIGNED = f"""{PAIRS}, {BENCHMARK_SQL}, al AS (
  SELECT p.instrument_id, p.ts, p.close / p.prev - 1 AS r, b.benchmark_close / q.benchmark_close - 1 AS b,
    p.close / p.prev - 1 - (b.benchmark_close / q.benchmark_close - 1) AS excess
  FROM p JOIN bench b ON b.ts = p.ts JOIN bench q ON q.ts = p.prev_ts
  WHERE p.prev > 0 AND p.close > 0 AND b.benchmark_close > 0 AND q.benchmark_close > 0
)"""


@query("cmp_01_aligned_returns", f"{ALIGNED} SELECT * FROM al", "r b excess")
def cmp_01(spark, d):
    return comparative.aligned_returns(bars(spark, d), benchmark(spark, d))


_H = (21, 63, 126, 252)
_SIDE = ", ".join(
    f"CASE WHEN count(CASE WHEN back < {n} THEN 1 END) = {n} THEN exp(sum(CASE WHEN back < {n} THEN ln(1 + {c}) END)) - 1 END AS {name}_return_{n}p"
    for name, c in (("instrument", "r"), ("benchmark", "b"))
    for n in _H
)


@query(
    "cmp_03_benchmark",
    f"""{ALIGNED}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM al),
    g AS (SELECT instrument_id, count(*) AS aligned_observations, covar_samp(r, b) / nullif(stddev_samp(r) * stddev_samp(b), 0) AS correlation,
      covar_samp(r, b) / nullif(var_samp(b), 0) AS beta, stddev_samp(excess) * sqrt(252) AS tracking_error,
      avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(252) AS information_ratio, {_SIDE} FROM k GROUP BY 1)
    SELECT *, {", ".join(f"instrument_return_{n}p - benchmark_return_{n}p AS excess_return_{n}p" for n in _H)} FROM g""",
    "correlation beta tracking_error information_ratio " + " ".join(f"{s}_return_{n}p" for s in ("instrument", "benchmark", "excess") for n in _H),
)
def cmp_03(spark, d):
    return comparative.benchmark_comparison(bars(spark, d), benchmark(spark, d), _H)


@query(
    "cmp_04_peer_returns",
    f"""{B}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM bars WHERE close > 0),
    own AS (SELECT a.instrument_id, h AS horizon, a.close / c.close - 1 AS value FROM k a CROSS JOIN (VALUES (1), (21), (63), (252)) AS x(h)
      LEFT JOIN k c ON c.instrument_id = a.instrument_id AND c.back = h WHERE a.back = 0),
    j AS (SELECT o.instrument_id, o.horizon, o.value, p.value AS peer FROM own o
      JOIN supplier s ON s.s_suppkey = o.instrument_id JOIN supplier t ON t.s_nationkey = s.s_nationkey AND t.s_suppkey <> s.s_suppkey
      JOIN own p ON p.instrument_id = t.s_suppkey AND p.horizon = o.horizon)
    SELECT instrument_id, horizon, max(value) AS target_return, count(peer) AS peer_observations, avg(peer) AS peer_mean,
      quantile_cont(peer, 0.5) AS peer_median, min(peer) AS peer_min, max(peer) AS peer_max,
      avg(CASE WHEN peer <= value THEN 1 ELSE 0 END) AS target_percentile, max(value) - quantile_cont(peer, 0.5) AS excess_vs_peer_median,
      (max(value) - avg(peer)) / nullif(stddev_samp(peer), 0) AS peer_zscore
    FROM j GROUP BY 1, 2""",
    "target_return peer_mean peer_median peer_min peer_max target_percentile excess_vs_peer_median peer_zscore",
)
def cmp_04(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.col("s_nationkey").alias("group"))
    return comparative.group_returns(bars(spark, d), s)


@query("cmp_05_given_peers", """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT a.k AS instrument_id, b.k AS peer_id FROM s a JOIN s b ON b.k IN (a.k + 1, a.k + 2)""")
def cmp_05(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument_id"))
    given = s.select(F.struct("instrument_id", F.array(*(F.col("instrument_id") + k for k in (1, 2, 1))).alias("peers")).alias("g"))
    return comparative.peer_table(given.select("g.*")).join(s.withColumnRenamed("instrument_id", "peer_id"), "peer_id", "left_semi").select("instrument_id", "peer_id")


@query("cmp_04_given_peers", f"""{B}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM bars WHERE close > 0),
    own AS (SELECT a.instrument_id, a.close / c.close - 1 AS value FROM k a LEFT JOIN k c ON c.instrument_id = a.instrument_id AND c.back = 21 WHERE a.back = 0)
    SELECT o.instrument_id, 21 AS horizon, max(o.value) AS target_return, count(p.value) AS peer_observations, avg(p.value) AS peer_mean FROM own o JOIN own p ON p.instrument_id IN (o.instrument_id + 1, o.instrument_id + 2) GROUP BY 1""", "target_return peer_mean")
def cmp_04_given(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument_id"))
    pairs = comparative.peer_table(s.withColumn("peers", F.array(F.col("instrument_id") + 1, F.col("instrument_id") + 2)))
    return comparative.peer_returns(bars(spark, d), pairs, (21,)).select("instrument_id", "horizon", "target_return", "peer_observations", "peer_mean")


@query(
    "exp_05_correlation_matrix",
    f"""{PAIRS}, r AS (SELECT instrument_id, ts, close / prev - 1 AS r, s_nationkey AS g FROM p JOIN supplier ON s_suppkey = instrument_id WHERE prev > 0),
    m AS (SELECT g, count(DISTINCT instrument_id) AS members FROM r GROUP BY 1),
    f AS (SELECT r.g, ts FROM r JOIN m ON m.g = r.g GROUP BY r.g, ts, members HAVING count(*) = members AND members >= 2),
    q AS (SELECT r.* FROM r JOIN f ON f.g = r.g AND f.ts = r.ts),
    c AS (SELECT a.instrument_id, b.instrument_id AS other, corr(a.r, b.r) AS correlation FROM q a JOIN q b ON a.g = b.g AND a.ts = b.ts
      AND a.instrument_id <> b.instrument_id GROUP BY 1, 2 HAVING count(*) >= 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY round(correlation, 9) DESC, other) AS k FROM c)
    SELECT instrument_id, count(*) AS partners, avg(correlation) AS mean_correlation, max(correlation) AS max_correlation,
    string_agg(CASE WHEN k <= 3 THEN other::VARCHAR END, ',' ORDER BY k) AS most_correlated FROM k GROUP BY 1""",
    "mean_correlation max_correlation",
)
def exp_05(spark, d):
    """Baskets are the suppliers of a nation; a basket without five days that all its members have gives no rows."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.col("s_nationkey").alias("group"))
    return comparative.correlation_summary(bars(spark, d).join(s, "instrument_id"))


_LB = ", ".join(f"('{name}', {n})" for name, n in regimes.LOOKBACKS)


@query(
    "reg_01_historical_state",
    f"""{B}, k AS (SELECT instrument_id, ts, close, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM bars),
    x AS (SELECT k.*, horizon, lag(close) OVER w AS prev, max(close) OVER w AS peak FROM k JOIN (VALUES {_LB}) AS v(horizon, n) ON back < n
      WINDOW w AS (PARTITION BY instrument_id, horizon ORDER BY ts)),
    y AS (SELECT *, CASE WHEN prev > 0 AND close > 0 THEN close / prev - 1 END AS r FROM x),
    g AS (SELECT instrument_id, horizon, count(*) AS observations, date_diff('day', min(ts), max(ts)) AS calendar_span_days,
      arg_max(close, ts) / arg_min(close, ts) AS z, stddev_samp(r) * sqrt(252) AS annualized_volatility,
      avg(CASE WHEN r > 0 THEN 1 WHEN r IS NOT NULL THEN 0 END) AS positive_return_fraction, max(r) AS best_period_return,
      min(r) AS worst_period_return, least(min(close / peak - 1), 0) AS maximum_drawdown FROM y GROUP BY 1, 2)
    SELECT instrument_id, horizon, observations, calendar_span_days, z - 1 AS cumulative_return,
      CASE WHEN calendar_span_days >= 365 THEN pow(z, 365.2425 / calendar_span_days) - 1 END AS annualized_return, annualized_volatility,
      positive_return_fraction, best_period_return, worst_period_return, maximum_drawdown FROM g WHERE observations >= 2""",
    "cumulative_return annualized_return annualized_volatility positive_return_fraction best_period_return worst_period_return maximum_drawdown",
)
def reg_01(spark, d):
    return regimes.historical_state(bars(spark, d))


@query(
    "reg_01_historical_percentiles",
    f"""{RETURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS k,
      first_value(close) OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS z FROM bars),
    s AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS k, first_value(r) OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS z FROM r)
    SELECT a.instrument_id, close_percentile, latest_return, latest_return_percentile FROM
     (SELECT instrument_id, 100.0 * sum(CASE WHEN close < z THEN 1 WHEN close = z THEN 0.5 ELSE 0 END) / count(*) AS close_percentile FROM c WHERE k <= 252 GROUP BY 1) a
     JOIN (SELECT instrument_id, max(z) AS latest_return, 100.0 * sum(CASE WHEN r < z THEN 1 WHEN r = z THEN 0.5 ELSE 0 END) / count(*) AS latest_return_percentile
       FROM s WHERE k <= 252 GROUP BY 1) b ON a.instrument_id = b.instrument_id""",
    "close_percentile latest_return latest_return_percentile",
)
def reg_01_percentiles(spark, d):
    return regimes.historical_percentiles(bars(spark, d))


@query(
    "reg_02_trend_state",
    f"""{B}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) - 1 AS back FROM bars),
    g AS (SELECT instrument_id, count(*) AS n, max(CASE WHEN back = 0 THEN close END) AS c, avg(CASE WHEN back < 20 THEN close END) AS s,
      avg(CASE WHEN back < 50 THEN close END) AS m, avg(CASE WHEN back < 200 THEN close END) AS l,
      (max(CASE WHEN back = 0 THEN close END) - max(CASE WHEN back = 19 THEN close END)) / 19 AS a,
      (max(CASE WHEN back = 0 THEN close END) - max(CASE WHEN back = 199 THEN close END)) / 199 AS b FROM k GROUP BY 1)
    SELECT instrument_id, a AS short_slope, b AS long_slope, CASE WHEN n < 50 THEN 'insufficient_history'
      WHEN n >= 200 AND c > m AND m > l AND a > 0 AND b >= 0 THEN 'strong_up' WHEN c > m AND a > 0 THEN 'up'
      WHEN n >= 200 AND c < m AND m < l AND a < 0 AND b <= 0 THEN 'strong_down' WHEN c < m AND a < 0 THEN 'down' ELSE 'neutral' END AS state,
      CASE WHEN n >= 20 THEN c > s END AS above_short, CASE WHEN n >= 50 THEN c > m END AS above_medium, CASE WHEN n >= 200 THEN c > l END AS above_long FROM g""",
    "short_slope long_slope",
)
def reg_02(spark, d):
    return regimes.trend_state(bars(spark, d)).drop("current_close", "sma_short", "sma_medium", "sma_long")


@query(
    "reg_03_volatility_state",
    f"""{RETURNS}, v AS (SELECT instrument_id, ts, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS v FROM r
      WINDOW w AS (PARTITION BY instrument_id ORDER BY ts ROWS 19 PRECEDING)),
    k AS (SELECT *, row_number() OVER w AS k, first_value(v) OVER w AS z FROM v WHERE v IS NOT NULL WINDOW w AS (PARTITION BY instrument_id ORDER BY ts DESC)),
    g AS (SELECT instrument_id, max(z) AS current_annualized_volatility, 100.0 * sum(CASE WHEN v < z THEN 1 WHEN v = z THEN 0.5 ELSE 0 END) / count(*) AS p,
      count(*) AS history_observations FROM k WHERE k <= 252 GROUP BY 1)
    SELECT instrument_id, current_annualized_volatility, p AS historical_percentile, history_observations,
      CASE WHEN p < 20 THEN 'low' WHEN p > 80 THEN 'high' ELSE 'normal' END AS state FROM g""",
    "current_annualized_volatility historical_percentile",
)
def reg_03(spark, d):
    return regimes.volatility_state(bars(spark, d))


@query(
    "reg_04_extremes",
    f"""{B}, h AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY close DESC, ts) AS a,
      row_number() OVER (PARTITION BY instrument_id ORDER BY close, ts) AS b, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS c FROM bars)
    SELECT x.instrument_id, x.ts AS all_time_high_ts, z.close / x.close - 1 AS distance_from_high, date_diff('day', x.ts, z.ts) AS days_since_high,
      y.ts AS all_time_low_ts, z.close / y.close - 1 AS distance_from_low, date_diff('day', y.ts, z.ts) AS days_since_low
    FROM h x JOIN h y ON x.instrument_id = y.instrument_id JOIN h z ON x.instrument_id = z.instrument_id WHERE x.a = 1 AND y.b = 1 AND z.c = 1""",
    "distance_from_high distance_from_low",
)
def reg_04(spark, d):
    return regimes.extremes(bars(spark, d))


@query(
    "reg_05_persistence",
    f"""{RETURNS}, s AS (SELECT instrument_id, ts, sign(r)::INT AS s, row_number() OVER w - row_number() OVER (PARTITION BY instrument_id, sign(r) ORDER BY ts) AS isl,
      row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    l AS (SELECT instrument_id, s, isl, count(*) AS n, max(i) AS z FROM s GROUP BY 1, 2, 3),
    a AS (SELECT instrument_id, sum(CASE WHEN s = 1 THEN n ELSE 0 END) / sum(n) AS positive_return_fraction,
      sum(CASE WHEN s = -1 THEN n ELSE 0 END) / sum(n) AS negative_return_fraction,
      CASE WHEN arg_max(s, z) = 1 THEN arg_max(n, z) ELSE 0 END AS current_positive_streak,
      CASE WHEN arg_max(s, z) = -1 THEN arg_max(n, z) ELSE 0 END AS current_negative_streak,
      max(CASE WHEN s = 1 THEN n ELSE 0 END) AS maximum_positive_streak, max(CASE WHEN s = -1 THEN n ELSE 0 END) AS maximum_negative_streak FROM l GROUP BY 1),
    m AS (SELECT instrument_id, ts, close, CASE WHEN count(close) OVER w = 200 THEN avg(close) OVER w END AS ma FROM bars
      WINDOW w AS (PARTITION BY instrument_id ORDER BY ts ROWS 199 PRECEDING)),
    b AS (SELECT instrument_id, avg(CASE WHEN ma IS NOT NULL THEN (close > ma)::INT END) AS fraction_above_ma, arg_max(close > ma, ts) AS current_above_ma FROM m GROUP BY 1)
    SELECT a.*, fraction_above_ma, current_above_ma FROM a JOIN b ON a.instrument_id = b.instrument_id""",
    "positive_return_fraction negative_return_fraction fraction_above_ma",
)
def reg_05(spark, d):
    return regimes.persistence(bars(spark, d))
