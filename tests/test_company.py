import datetime as dt

import pytest

from quantloom.operators import events, fundamentals, ownership
from tests.helpers import bars, one

near = pytest.approx
QUARTERS = [dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 9, 30), dt.date(2025, 12, 31), dt.date(2026, 3, 31)]


def statements(spark, rows, names):
    return spark.createDataFrame([("i", q, "quarterly", *map(float, v)) for q, *v in rows], "instrument_id string, period_end date, period_type string, " + ", ".join(f"{n} double" for n in names))


def test_growth_and_gap(spark):
    s = statements(spark, zip(QUARTERS, (100, 120, 130, 140, 150), strict=True), ["revenue"])
    last = {r["basis"]: r["growth"] for r in fundamentals.growth(s).collect() if r["period_end"] == QUARTERS[-1]}
    assert last == {"qoq": near(150 / 140 - 1), "yoy": near(0.5)}
    holed = s.where(f"period_end <> '{QUARTERS[2]}'")
    assert fundamentals.period_gaps(holed, ("revenue",)).count() == 1


def test_trailing_sum(spark):
    s = statements(spark, zip(QUARTERS, (100, 110, 120, 130, 140), strict=True), ["revenue"])
    out = {r["period_end"]: r["ttm"] for r in fundamentals.trailing(s).collect()}
    assert out == {QUARTERS[3]: 460, QUARTERS[4]: 500}
    assert fundamentals.trailing(s.where(f"period_end <> '{QUARTERS[2]}'")).count() == 0


def test_profitability_solvency_cash_flow(spark):
    s = statements(spark, [(QUARTERS[0], 0, 500, 1200, 1000), (QUARTERS[1], 144, 600, 1400, 1200)], ["net_income", "total_equity", "total_assets", "revenue"])
    r = fundamentals.profitability(s).orderBy("period_end").collect()[1]
    assert r["net_margin"] == near(0.12) and r["roe"] == near(144 / 550) and r["roa"] == near(144 / 1300)
    names = ["total_debt", "cash", "total_equity", "current_assets", "inventory", "current_liabilities", "ebitda", "ebit", "interest_expense"]
    r = one(fundamentals.solvency(statements(spark, [(QUARTERS[0], 200, 50, 500, 300, 50, 150, 150, 100, 20)], names)))
    assert [r[c] for c in ("debt_to_equity", "net_debt_to_ebitda", "current_ratio", "quick_ratio", "interest_coverage")] == near([0.4, 1.0, 2.0, 5 / 3, 5.0])
    r = one(fundamentals.cash_flow(statements(spark, [(QUARTERS[0], 1000, 220, -70, 180)], ["revenue", "operating_cash_flow", "capital_expenditure", "net_income"])))
    assert [r[c] for c in ("free_cash_flow", "operating_cash_flow_margin", "free_cash_flow_margin", "cash_conversion", "capital_intensity")] == near([150, 0.22, 0.15, 220 / 180, 0.07])


def test_shareholding_changes(spark):
    rows = [("i", QUARTERS[0], 50.0, 30.0, 10.0, 10.0, None), ("i", QUARTERS[1], None, 28.5, 11.0, 9.0, None), ("i", QUARTERS[2], 52.0, 28.5, 11.0, 9.0, None)]
    s = spark.createDataFrame(rows, "instrument_id string, period_end date, promoter double, public double, fii double, dii double, government double")
    r = one(ownership.shareholding_changes(s))
    assert r["promoter_change"] == 2 and r["public_change"] == 0 and r["government_change"] is None


def test_insiders(spark):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = [("i", day(1), "a", 100.0, 0.0, 1000.0, 0.0), ("i", day(5), "b", 0.0, 40.0, 0.0, 600.0), ("i", day(80), "a", 50.0, 0.0, 400.0, 0.0)]
    df = spark.createDataFrame(rows, "instrument_id string, event_time timestamp, person_name string, buy_quantity double, sell_quantity double, buy_value double, sell_value double")
    out = {r["window"]: r for r in ownership.insider_activity(df, (30, 90)).collect()}
    assert out[30]["transactions"] == 1 and out[90]["transactions"] == 3 and out[90]["people"] == 2
    assert out[90]["buy_quantity"] == 150 and out[90]["sell_quantity"] == 40 and out[90]["net_value"] == 800


def test_deals(spark):
    rows = [("i", dt.datetime(2026, 1, 2), "BUY", 100.0, 10.0, None, "x", "bulk"), ("i", dt.datetime(2026, 1, 3), "SELL", 50.0, 12.0, None, "y", "block")]
    df = spark.createDataFrame(rows, "instrument_id string, event_time timestamp, side string, quantity double, price double, value double, client string, deal_type string")
    r = one(ownership.large_deals(df, (30,)))
    assert (r["buy_value"], r["sell_value"], r["net_value"], r["clients"], r["types"]) == (1000, 600, 400, 2, "block:1,bulk:1")


def test_reaction_starts_strictly_after_the_event(spark):
    prices = bars(spark, [100 + 5 * k for k in range(6)])
    event = spark.createDataFrame([("i", 1, dt.datetime(2026, 1, 2))], "instrument_id string, event_id long, event_time timestamp")
    r = one(events.market_reaction(event, prices, (1, 3)))
    assert r["base_price"] == 110 and r["return_1"] == near(115 / 110 - 1) and r["return_3"] == near(125 / 110 - 1)
    r = one(events.market_reaction(event, bars(spark, [100, 105, 110]), (1, 3)))
    assert r["return_1"] is None and r["return_3"] is None
