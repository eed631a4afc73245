"""Recursive means over many blocks against a plain loop, and candle patterns by hand."""

import datetime as dt
import math
import random

import pytest

from quantloom.operators import candles, indicators, market, scan
from tests.helpers import BAR, BASE, bars


def plain(values, n, alpha):
    if len(values) < n:
        return [None] * len(values)
    out = [None] * (n - 1) + [sum(values[:n]) / n]
    for v in values[n:]:
        out.append((1 - alpha) * out[-1] + alpha * v)
    return out


@pytest.mark.parametrize("size", [11, 12, 512, 513, 1700])
def test_means_match_a_loop_over_any_number_of_blocks(spark, size):
    rng = random.Random(size)
    closes = [100 + 50 * math.sin(k / 40) + rng.random() for k in range(size)]
    found: dict = {}
    for r in market.exponential_averages(bars(spark, closes), (3, 12, 200)).collect():
        found.setdefault(r["window"], {})[r["ts"]] = r["value"]
    for n in (3, 12, 200):
        expected = {BASE + dt.timedelta(days=k): y for k, y in enumerate(plain(closes, n, 2 / (n + 1))) if y is not None}
        assert found.get(n, {}).keys() == expected.keys()
        assert all(abs(found[n][t] - y) < 1e-9 * max(1, abs(y)) for t, y in expected.items())


def test_rsi_and_macd_over_blocks_match_a_loop(spark):
    rng = random.Random(2)
    closes = [100 * math.exp(rng.gauss(0, 0.02)) for _ in range(1200)]
    out = market.technical_indicators(bars(spark, closes)).orderBy("ts").collect()
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = plain([max(m, 0) for m in moves], 14, 1 / 14), plain([max(-m, 0) for m in moves], 14, 1 / 14)
    macd = [None if b is None else a - b for a, b in zip(plain(closes, 12, 2 / 13), plain(closes, 26, 2 / 27))]
    signal = [None] * 25 + plain(macd[25:], 9, 0.2)
    assert len(out) == len(closes)
    for k, r in enumerate(out):
        rsi = None if k == 0 or gain[k - 1] is None else 100 - 100 / (1 + gain[k - 1] / loss[k - 1])
        for have, want in ((r["rsi"], rsi), (r["macd"], macd[k]), (r["signal"], signal[k])):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9 * max(1, abs(want)))


def test_plans_have_no_python(spark):
    rows = bars(spark, range(1, 60))
    for df in (market.technical_indicators(rows), indicators.directional_movement(rows), market.exponential_averages(rows), candles.candle_patterns(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_means_without_end_of_block_are_an_error():
    with pytest.raises(ValueError, match="blocks"):
        scan.smoothed(None, [scan.Smoothing("x", None, 600, 0.1)])


def patterns(spark, *candles_):
    rows = [("i", BASE + dt.timedelta(days=k), *map(float, c), 1.0, 1.0, 1.0) for k, c in enumerate(candles_)]
    out: dict = {}
    for r in candles.candle_patterns(spark.createDataFrame(rows, BAR)).collect():
        out.setdefault((r["ts"] - BASE).days, set()).add(r["pattern"])
    return out


def test_patterns_by_hand(spark):  # open, high, low, close
    assert patterns(spark, (10, 11, 9, 10)) == {0: {"doji"}}
    assert patterns(spark, (10, 10.5, 7, 10.4), (10, 10, 10, 10)) == {0: {"hammer"}, 1: {"doji"}}
    assert patterns(spark, (10, 13, 9.95, 10.2)) == {0: {"doji", "shooting_star"}}
    assert patterns(spark, (10, 15, 10, 15), (14, 14, 9, 9)) == {0: {"marubozu"}, 1: {"marubozu"}}
    assert patterns(spark, (12, 12.5, 9.5, 11), (10.5, 13.5, 10, 13)) == {1: {"bullish_engulfing"}}
    assert patterns(spark, (11, 12.5, 10.5, 12), (12.5, 13, 9.5, 10)) == {1: {"bearish_engulfing"}}
    assert patterns(spark, (14, 15, 9, 10), (11, 12.5, 10.5, 12)) == {1: {"bullish_harami"}}
    assert patterns(spark, (20, 21, 14, 15), (14, 14.6, 13.4, 14.2), (14.5, 19.3, 14.2, 18.5)) == {2: {"morning_star"}}
    assert patterns(spark, (15, 21, 14, 20), (21, 21.6, 20.4, 20.8), (20.5, 20.8, 15.2, 16)) == {2: {"evening_star"}}
    assert patterns(spark, (10, 12.5, 9.7, 12), (11, 13.6, 10.7, 13), (12.5, 15.2, 12.2, 14.5)) == {2: {"three_white_soldiers"}}
    assert patterns(spark, (15, 15.3, 12.6, 13), (14, 14.3, 11.6, 12), (12.5, 12.8, 9.9, 10.5)) == {2: {"three_black_crows"}}
