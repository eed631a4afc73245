import datetime as dt

import pytest

from quantloom.operators import comparative, indicators, market, regimes
from tests.helpers import BASE, bars, one, values

near = pytest.approx


def test_returns(spark):
    out = market.returns(bars(spark, [100, 110, 121]))
    assert values(out, "return_1p") == near([0.1, 0.1]) and values(out, "cumulative_return")[-1] == near(0.21)


def test_zero_and_negative_prices(spark):
    prices = bars(spark, [100, 0, 50, 55])
    assert values(market.returns(prices), "return_1p") == near([0.1])
    assert market.zero_denominators(prices).count() == 1
    assert market.returns(bars(spark, [100])).count() == 0


def test_horizons(spark):
    r = one(market.return_horizons(bars(spark, [100 + k for k in range(520)])))
    assert r["return_252"] == near(619 / 367 - 1) and r["annualised"] == near((619 / 100) ** (365.2425 / 519) - 1)


def test_rolling_volatility_and_summary(spark):
    assert market.rolling_volatility(bars(spark, [100 * 1.001**k for k in range(70)])).where("window = 20").count() == 50
    s = one(market.volatility_summary(bars(spark, [100 + 0.5 * k for k in range(20)])))
    assert s["n_returns"] == 19 and s["p95"] >= s["p05"]


def test_drawdown(spark):
    r = one(market.drawdown_summary(bars(spark, [100, 120, 90, 110])))
    assert r["max_drawdown"] == near(-0.25) and r["trough_ts"] == BASE + dt.timedelta(days=2) and r["time_since_peak_days"] == 2


def test_moving_average_and_liquidity(spark):
    r = values(market.moving_averages(bars(spark, [100, 110, 120, 130]), (3,)), "average")
    assert r[-1] == near(120)
    q = one(market.liquidity(bars(spark, [100, 110, 120]), (3,)))
    assert q["avg_volume"] == near(1100) and q["volume_coverage"] == 1


def test_indicators_match_plain_recursion(spark):
    closes = [100 + (k * 7 % 13) - (k % 5) for k in range(60)]
    out = market.technical_indicators(bars(spark, closes)).orderBy("ts").collect()

    def ema(xs, n):
        got, e = [None] * (n - 1), sum(xs[:n]) / n
        got.append(e)
        for x in xs[n:]:
            e = x * 2 / (n + 1) + e * (1 - 2 / (n + 1))
            got.append(e)
        return got

    fast, slow = ema(closes, 12), ema(closes, 26)
    macd = [a - b for a, b in zip(fast, slow, strict=True) if b is not None]
    assert out[-1]["macd"] == near(macd[-1]) and out[-1]["signal"] == near(ema(macd, 9)[-1])
    moves = [b - a for a, b in zip(closes, closes[1:], strict=False)]
    gain, loss = (sum(max(s * m, 0) for m in moves[:14]) / 14 for s in (1, -1))
    for m in moves[14:]:
        gain, loss = (gain * 13 + max(m, 0)) / 14, (loss * 13 + max(-m, 0)) / 14
    assert out[-1]["rsi"] == near(100 - 100 / (1 + gain / loss))
    assert market.technical_indicators(bars(spark, [1, 2, 3])).count() == 0


def test_relative_and_benchmark(spark):
    b = bars(spark, [100, 105, 99.75, 109.725]).selectExpr("ts", "close AS benchmark_close")
    prices = bars(spark, [100, 106, 101.76, 112.9536])
    r = one(comparative.benchmark_comparison(prices, b))
    assert r["aligned_observations"] == 3 and r["beta"] == near(1.0)
    assert values(comparative.aligned_returns(prices, b), "excess")[0] == near(0.01)
    later = bars(spark, [1, 2], base=BASE + dt.timedelta(days=10)).selectExpr("ts", "close AS benchmark_close")
    assert comparative.benchmark_comparison(prices, later).count() == 0


def test_peers(spark):
    prices = bars(spark, [100, 130], "t").unionByName(bars(spark, [100, 110], "a")).unionByName(bars(spark, [100, 115], "b")).unionByName(bars(spark, [100, 125], "c"))
    peers = spark.createDataFrame([("t", x) for x in "abc"], "instrument_id string, peer_id string")
    r = one(comparative.peer_returns(prices, peers, (1,)).where("instrument_id = 't'"))
    assert r["peer_median"] == near(0.15) and r["excess_vs_peer_median"] == near(0.15) and r["target_percentile"] == 1.0


def test_regimes(spark):
    assert one(regimes.trend_state(bars(spark, [100 + k for k in range(260)])))["state"] == "strong_up"
    prices = bars(spark, [100, 110, 120, 115, 125, 130, 128, 140])
    e, p = one(regimes.extremes(prices)), one(regimes.persistence(prices, 3))
    assert e["days_since_high"] == 0 and e["days_since_low"] == 7 and p["current_above_ma"] and p["maximum_positive_streak"] == 2
    assert one(regimes.historical_state(bars(spark, [100 + k for k in range(60)]), (("1y", 252),)))["observations"] == 60


def test_performance_of_a_steady_rise(spark):
    r = one(indicators.performance(bars(spark, [100 * 1.01**k for k in range(40)])))
    assert r["max_drawdown"] == 0 and r["calmar"] is None and r["value_at_risk"] == near(0.01)


def test_empty_prices(spark):
    empty = bars(spark, [1]).limit(0)
    for operator in (market.returns, market.return_horizons, market.drawdown_summary, market.technical_indicators, regimes.persistence, indicators.performance):
        assert operator(empty).count() == 0


def test_nearest_of_many_queries_is_whole(spark):
    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 5 + 1), float(k % 3)]) for k in range(40)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, indicators.nearest(vectors, vectors).collect()))
    assert len(want) == 120 and sorted(map(tuple, indicators.nearest(vectors, vectors, most=15).collect())) == want
