"""Queries of the statement, ownership and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import events, fundamentals, ownership
from quantloom.plans.catalog import query
from quantloom.sources.driver_tables import DEALS_SQL, SHAREHOLDING_SQL, STATEMENTS_SQL, company_events, deals, read, shareholding, statements

S = f"WITH {STATEMENTS_SQL}"
_LONG = " UNION ALL ".join(f"SELECT instrument_id, period_end, period_type, '{m}' AS metric, {m} AS value FROM statements WHERE {m} IS NOT NULL" for m in ("revenue", "gross_profit", "ebitda", "ebit", "net_income", "operating_cash_flow", "capital_expenditure"))
LONG = f"{S}, l AS (SELECT *, year(period_end) * 4 + quarter(period_end) AS q FROM ({_LONG}))"
W = "WINDOW w AS (PARTITION BY instrument_id, metric ORDER BY period_end)"


@query(
    "fnd_05_merge_periods",
    f"""{S} SELECT instrument_id, period_end, period_type, revenue, ebit FROM statements""",
    "revenue ebit",
)
def fnd_05(spark, d):
    s = statements(spark, d)
    part = lambda seq, c, v: F.struct(F.lit(seq).alias("seq"), F.lit(c).alias("concept"), v.alias("value"))
    long = s.select(*fundamentals.PERIOD, F.inline(F.array(part(2, "revenue", -F.col("revenue")), part(1, "revenue", F.col("revenue")), part(1, "ebit", F.lit(None).cast("double")), part(3, "ebit", F.col("ebit")))))
    return fundamentals.merged_periods(long, ("revenue", "ebit"))


_GROWTH = [m for m in fundamentals.GROWTH if m != "eps"]


@query(
    "fnd_10_growth",
    f"""{LONG}, g AS (SELECT *, lag(value, 1) OVER w AS p1, lag(q, 1) OVER w AS q1, lag(value, 4) OVER w AS p4, lag(q, 4) OVER w AS q4 FROM l {W})
    SELECT instrument_id, period_end, period_type, metric, 'qoq' AS basis, value / p1 - 1 AS growth FROM g WHERE p1 <> 0 AND q - q1 = 1 AND metric <> 'capital_expenditure'
    UNION ALL SELECT instrument_id, period_end, period_type, metric, 'yoy', value / p4 - 1 FROM g WHERE p4 <> 0 AND q - q4 = 4 AND metric <> 'capital_expenditure'""",
    "growth",
)
def fnd_10(spark, d):
    return fundamentals.growth(statements(spark, d))


def shifted(spark, d):
    """All statements, three out of four instruments' later by one to three quarters for each year since 1992: gaps of
    known size between the years."""
    quarters = (F.year("period_end") - 1992) * (F.col("instrument_id") % 4)
    return statements(spark, d).withColumn("period_end", F.last_day(F.add_months("period_end", (quarters * 3).cast("int"))))


@query(
    "fnd_06_period_gaps",
    f"""{S}, m AS (SELECT * REPLACE (last_day(period_end + to_months((3 * (year(period_end) - 1992) * (instrument_id % 4))::INTEGER)) AS period_end) FROM statements),
    g AS (SELECT *, year(period_end) * 4 + quarter(period_end) AS q, lag(year(period_end) * 4 + quarter(period_end)) OVER w AS q1
      FROM (SELECT instrument_id, period_end, period_type, 'revenue' AS metric FROM m WHERE revenue IS NOT NULL) {W})
    SELECT instrument_id, period_end, period_type, metric, 'period_gap' AS code FROM g WHERE q - q1 <> 1""",
)
def fnd_06(spark, d):
    return fundamentals.period_gaps(shifted(spark, d), ("revenue",))


@query(
    "fnd_06_period_gaps_all",
    f"""{S}, m AS (SELECT * REPLACE (last_day(period_end + to_months((3 * (year(period_end) - 1992) * (instrument_id % 4))::INTEGER)) AS period_end) FROM statements),
    g AS (SELECT *, year(period_end) * 4 + quarter(period_end) AS q, lag(year(period_end) * 4 + quarter(period_end)) OVER w AS q1
      FROM (SELECT instrument_id, period_end, period_type, 'revenue' AS metric FROM m WHERE revenue IS NOT NULL) {W})
    SELECT instrument_id, period_end, period_type, metric, 'period_gap' AS code FROM g WHERE q - q1 <> 1""",
)
def fnd_06_all(spark, d):
    return fundamentals.period_gaps(shifted(spark, d), ("revenue",))


@query(
    "fnd_11_ttm",
    f"""{LONG}, g AS (SELECT *, sum(value) OVER f AS ttm, count(*) OVER f AS n, min(q) OVER f AS q0 FROM l
      WINDOW f AS (PARTITION BY instrument_id, metric ORDER BY period_end ROWS 3 PRECEDING))
    SELECT instrument_id, period_end, metric, ttm FROM g WHERE n = 4 AND q - q0 = 3 AND metric <> 'gross_profit'""",
    "ttm",
)
def fnd_11(spark, d):
    return fundamentals.trailing(statements(spark, d))


@query(
    "fnd_12_profitability",
    f"""{S} SELECT instrument_id, period_end, period_type, gross_profit / nullif(revenue, 0) AS gross_margin, ebitda / nullif(revenue, 0) AS ebitda_margin,
    ebit / nullif(revenue, 0) AS ebit_margin, net_income / nullif(revenue, 0) AS net_margin,
    net_income / nullif((total_equity + lag(total_equity) OVER w) / 2, 0) AS roe, net_income / nullif((total_assets + lag(total_assets) OVER w) / 2, 0) AS roa
    FROM statements WINDOW w AS (PARTITION BY instrument_id ORDER BY period_end)""",
    "gross_margin ebitda_margin ebit_margin net_margin roe roa",
)
def fnd_12(spark, d):
    return fundamentals.profitability(statements(spark, d))


@query(
    "fnd_13_solvency",
    f"""{S} SELECT instrument_id, period_end, period_type, total_debt / nullif(total_equity, 0) AS debt_to_equity, (total_debt - cash) / nullif(ebitda, 0) AS net_debt_to_ebitda,
    current_assets / nullif(current_liabilities, 0) AS current_ratio, (current_assets - inventory) / nullif(current_liabilities, 0) AS quick_ratio,
    ebit / nullif(abs(interest_expense), 0) AS interest_coverage FROM statements""",
    "debt_to_equity net_debt_to_ebitda current_ratio quick_ratio interest_coverage",
)
def fnd_13(spark, d):
    return fundamentals.solvency(statements(spark, d))


@query(
    "fnd_14_cashflow",
    f"""{S}, c AS (SELECT *, operating_cash_flow - abs(capital_expenditure) AS free_cash_flow FROM statements)
    SELECT instrument_id, period_end, period_type, free_cash_flow, operating_cash_flow / nullif(revenue, 0) AS operating_cash_flow_margin,
    free_cash_flow / nullif(revenue, 0) AS free_cash_flow_margin, operating_cash_flow / nullif(net_income, 0) AS cash_conversion, abs(capital_expenditure) / nullif(revenue, 0) AS capital_intensity FROM c""",
    "free_cash_flow operating_cash_flow_margin free_cash_flow_margin cash_conversion capital_intensity",
)
def fnd_14(spark, d):
    return fundamentals.cash_flow(statements(spark, d))


_QUOTED = f"""{S}, s AS (SELECT *, revenue - gross_profit AS cost, total_assets * 0.1::DOUBLE AS receivables, 1000.0::DOUBLE + instrument_id AS shares, revenue * 5 AS market_cap, net_income * 0.3::DOUBLE AS dividends,
  operating_cash_flow - abs(capital_expenditure) AS fcf FROM statements),
x AS (SELECT instrument_id, period_end, period_type,
  revenue / nullif(total_assets, 0) AS asset_turnover, cost / nullif(inventory, 0) AS inventory_turnover, revenue / nullif(receivables, 0) AS receivables_turnover,
  revenue / nullif(current_assets - current_liabilities, 0) AS working_capital_turnover, cash / nullif(current_liabilities, 0) AS cash_ratio, operating_cash_flow / nullif(current_liabilities, 0) AS operating_cash_ratio,
  current_assets / nullif(current_liabilities, 0) AS current_ratio, total_debt / nullif(total_assets, 0) AS debt_to_assets, total_debt / nullif(total_equity, 0) AS debt_to_equity,
  gross_profit / nullif(revenue, 0) AS gross_margin, ebit / nullif(revenue, 0) AS operating_margin, ebitda / nullif(revenue, 0) AS ebitda_margin, net_income / nullif(revenue, 0) AS net_margin,
  net_income / nullif(total_equity, 0) AS return_on_equity, net_income / nullif(total_assets, 0) AS return_on_assets, ebit / nullif(total_assets - current_liabilities, 0) AS return_on_capital,
  total_equity / shares AS equity_per_share, net_income / shares AS earnings_per_share, revenue / shares AS revenue_per_share, fcf / shares AS cash_flow_per_share,
  fcf / nullif(market_cap, 0) AS cash_flow_yield, market_cap / nullif(net_income, 0) AS price_to_earnings, market_cap / nullif(total_equity, 0) AS price_to_book, market_cap / nullif(revenue, 0) AS price_to_sales,
  (market_cap + total_debt - cash) / nullif(ebitda, 0) AS value_to_ebitda, (market_cap + total_debt - cash) / nullif(revenue, 0) AS value_to_revenue,
  ebit / nullif(abs(interest_expense), 0) AS interest_coverage, total_debt / nullif(total_debt + total_equity, 0) AS debt_to_capital, dividends / nullif(net_income, 0) AS payout_ratio, (current_assets - inventory) / nullif(current_liabilities, 0) AS quick_ratio,
  (total_equity / shares - lag(total_equity / shares) OVER w) / nullif(abs(lag(total_equity / shares) OVER w), 0) AS equity_per_share_change,
  365 / nullif(cost / nullif(inventory, 0), 0) AS inventory_days, 365 / nullif(revenue / nullif(receivables, 0), 0) AS collection_days,
  {", ".join(f"({c} - lag({c}) OVER w) / nullif(abs(lag({c}) OVER w), 0) AS {n}_change" for n, c in (("revenue", "revenue"), ("net_income", "net_income"), ("total_equity", "total_equity"), ("free_cash_flow", "fcf"), ("ebit", "ebit"), ("ebitda", "ebitda")))},
  (net_income / shares - lag(net_income / shares) OVER w) / nullif(abs(lag(net_income / shares) OVER w), 0) AS earnings_per_share_change
  FROM s WINDOW w AS (PARTITION BY instrument_id ORDER BY period_end) QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY period_end DESC) = 1)"""


@query(
    "exp_01_extended_ratios",
    f"{_QUOTED} SELECT *, inventory_days + collection_days AS cash_cycle_days, price_to_earnings / nullif(100 * earnings_per_share_change, 0) AS peg_ratio FROM x",
    " ".join([*fundamentals.QUOTIENTS, "inventory_days", "collection_days", "cash_cycle_days", *(f"{c}_change" for c in fundamentals.CHANGES), "equity_per_share_change", "peg_ratio"]),
)
def exp_01(spark, d):
    return fundamentals.extended_ratios(quoted_statements(spark, d))


def quoted_statements(spark, d):
    c = F.col
    more = {"cost_of_revenue": c("revenue") - c("gross_profit"), "receivables": c("total_assets") * 0.1, "shares": c("instrument_id") + 1000.0, "market_cap": c("revenue") * 5, "dividends": c("net_income") * 0.3}
    return statements(spark, d).withColumns(more)


@query(
    "exp_01_snapshot",
    f"{_QUOTED} SELECT instrument_id, period_end, period_type, asset_turnover AS asset_efficiency, equity_per_share_change AS book_equity_growth, quick_ratio AS acid_test_ratio, price_to_earnings / nullif(100 * earnings_per_share_change, 0) AS growth_adjusted_pe, return_on_capital AS invested_capital_return, revenue_change AS sales_growth FROM x",
    "asset_efficiency book_equity_growth acid_test_ratio growth_adjusted_pe invested_capital_return sales_growth",
)
def exp_01_snapshot(spark, d):
    found = fundamentals.snapshot(fundamentals.extended_ratios(quoted_statements(spark, d)))
    return found.select("instrument_id", "period_end", "period_type", "asset_efficiency", "book_equity_growth", "acid_test_ratio", "growth_adjusted_pe", "invested_capital_return", "sales_growth")


@query(
    "exp_02_fundamental_score",
    f"""{S}, x AS (SELECT instrument_id, nullif(CASE WHEN instrument_id % 7 <> 0 THEN net_income / nullif(total_equity, 0) END, 0) AS a, nullif(total_debt / nullif(total_equity, 0), 0) AS b, nullif(ebit / nullif(revenue, 0), 0) AS c,
      nullif(current_assets / nullif(current_liabilities, 0), 0) AS e FROM statements QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY period_end DESC) = 1),
    y AS (SELECT *, round(a * 100 + 1e-9::DOUBLE, 1)::DECIMAL(20,1)::VARCHAR || '%' AS said_a, round(b + 1e-9::DOUBLE, 1)::DECIMAL(20,1)::VARCHAR AS said_b, round(c * 100 + 1e-9::DOUBLE, 1)::DECIMAL(20,1)::VARCHAR || '%' AS said_c, round(e + 1e-9::DOUBLE, 1)::DECIMAL(20,1)::VARCHAR AS said_e FROM x)
    SELECT instrument_id, (CASE WHEN a > 0.15 THEN 2 ELSE 0 END + CASE WHEN b < 0.5 THEN 2 ELSE 0 END + CASE WHEN c > 0.15 THEN 2 ELSE 0 END + CASE WHEN e > 1.5 THEN 1 ELSE 0 END)::BIGINT AS score,
    concat_ws('; ', CASE WHEN a IS NULL THEN 'ROE data not available' WHEN a > 0.15 THEN 'Strong ROE of ' || said_a ELSE 'Weak ROE of ' || said_a END,
      CASE WHEN b IS NULL THEN 'Debt to equity data not available' WHEN b < 0.5 THEN 'Conservative debt levels' ELSE 'High debt to equity ratio of ' || said_b END,
      CASE WHEN c IS NULL THEN 'Operating margin data not available' WHEN c > 0.15 THEN 'Strong operating margins' ELSE 'Weak operating margin of ' || said_c END,
      CASE WHEN e IS NULL THEN 'Current ratio data not available' WHEN e > 1.5 THEN 'Good liquidity position' ELSE 'Weak liquidity with current ratio of ' || said_e END) AS reasons FROM y""",
)
def exp_02(spark, d):
    s = statements(spark, d)
    latest = s.groupBy("instrument_id").agg(F.max_by(F.struct(*(c for c in s.columns if c != "instrument_id")), "period_end").alias("s")).select("instrument_id", "s.*")
    div = lambda a, b: F.try_divide(a, b)
    rows = latest.select(
        "instrument_id", F.when(F.col("instrument_id") % 7 != 0, div(F.col("net_income"), F.col("total_equity"))).alias("roe"), div(F.col("total_debt"), F.col("total_equity")).alias("debt_to_equity"),
        div(F.col("ebit"), F.col("revenue")).alias("operating_margin"), div(F.col("current_assets"), F.col("current_liabilities")).alias("current_ratio"),
    )
    return fundamentals.scored(rows)


# ---- ownership ----

_H = ownership.HOLDERS


@query(
    "own_02_shareholding_changes",
    f"""WITH {SHAREHOLDING_SQL}, x AS (SELECT *, {", ".join(f"last_value({h} IGNORE NULLS) OVER w AS {h}_before" for h in _H)},
      row_number() OVER (PARTITION BY instrument_id ORDER BY period_end DESC) AS k FROM holdings
      WINDOW w AS (PARTITION BY instrument_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT instrument_id, period_end, {", ".join(_H)}, {", ".join(f"{h} - {h}_before AS {h}_change" for h in _H)} FROM x WHERE k = 1""",
    " ".join(_H) + " " + " ".join(f"{h}_change" for h in _H),
)
def own_02(spark, d):
    return ownership.shareholding_changes(shareholding(spark, d))


_WINDOWED = f"""WITH {DEALS_SQL}, a AS (SELECT instrument_id, max(event_time) AS anchor FROM deals GROUP BY 1),
x AS (SELECT deals.*, days AS "window", CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS s FROM deals JOIN a USING (instrument_id)
  CROSS JOIN (VALUES (30), (90), (365)) AS v(days) WHERE event_time >= anchor - to_days(days::INTEGER))"""


@query(
    "own_04_insider_activity",
    f"""{_WINDOWED}, g AS (SELECT instrument_id, "window", count(*) AS transactions, count(DISTINCT client) AS people,
      sum(CASE WHEN s > 0 THEN quantity ELSE 0 END) AS buy_quantity, sum(CASE WHEN s < 0 THEN quantity ELSE 0 END) AS sell_quantity, sum(s * quantity) AS net_quantity,
      sum(CASE WHEN s > 0 THEN value ELSE 0 END) AS buy_value, sum(CASE WHEN s < 0 THEN value ELSE 0 END) AS sell_value, sum(s * value) AS net_value FROM x GROUP BY 1, 2)
    SELECT *, buy_quantity / nullif(sell_quantity, 0) AS quantity_ratio, buy_value / nullif(sell_value, 0) AS value_ratio FROM g""",
    "buy_quantity sell_quantity net_quantity buy_value sell_value net_value quantity_ratio value_ratio",
)
def own_04(spark, d):
    word = F.when(F.col("side") == "buy", "Market Purchase").otherwise("Market Sale")
    return ownership.insider_activity(deals(spark, d).withColumn("transaction_type", word), person="client")


@query(
    "own_05_large_deals",
    f"""{_WINDOWED}, t AS (SELECT instrument_id, "window", deal_type, count(*) AS n FROM x GROUP BY 1, 2, 3),
    k AS (SELECT instrument_id, "window", string_agg(deal_type || ':' || n, ',' ORDER BY deal_type) AS types FROM t GROUP BY 1, 2),
    g AS (SELECT instrument_id, "window", count(*) AS deals, sum(quantity * price) AS gross_value, sum(CASE WHEN s > 0 THEN quantity * price ELSE 0 END) AS buy_value,
      sum(CASE WHEN s < 0 THEN quantity * price ELSE 0 END) AS sell_value, count(DISTINCT client) AS clients FROM x GROUP BY 1, 2)
    SELECT g.*, buy_value - sell_value AS net_value, buy_value / nullif(sell_value, 0) AS ratio, types FROM g JOIN k USING (instrument_id, "window")""",
    "gross_value buy_value sell_value net_value ratio",
)
def own_05(spark, d):
    return ownership.large_deals(deals(spark, d))


# ---- events ----


@query(
    "evt_02_company_summary",
    """WITH a AS (SELECT user_id, max(ts) AS anchor FROM events GROUP BY 1),
    x AS (SELECT e.*, days AS "window", anchor FROM events e JOIN a ON a.user_id = e.user_id CROSS JOIN (VALUES (3), (10), (30)) AS v(days) WHERE ts >= anchor - to_days(days::INTEGER)),
    t AS (SELECT user_id, "window", event_type, count(*) AS n FROM x GROUP BY 1, 2, 3),
    k AS (SELECT user_id, "window", string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS types, count(*) AS distinct_types FROM t GROUP BY 1, 2)
    SELECT x.user_id AS instrument_id, x."window", count(*) AS events, max(distinct_types) AS distinct_types, max(types) AS types, max(ts) AS last_event, 0.0::DOUBLE AS days_since
    FROM x JOIN k ON k.user_id = x.user_id AND k."window" = x."window" GROUP BY 1, 2""",
    "days_since",
)
def evt_02(spark, d):
    return events.company_summary(company_events(spark, d), (3, 10, 30))


@query(
    "evt_03_market_reaction",
    """WITH p AS (SELECT user_id, ts, value AS price, lead(value, 1) OVER w AS n1, lead(value, 5) OVER w AS n5, lead(value, 21) OVER w AS n21 FROM events WHERE event_type <> 'signup' AND value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'),
    b AS (SELECT e.event_id, min(p.ts) AS base_ts FROM e JOIN p ON p.user_id = e.user_id AND p.ts > e.ts GROUP BY 1)
    SELECT e.user_id AS instrument_id, e.event_id, e.ts AS event_time, b.base_ts, p.price AS base_price, n1 / price - 1 AS return_1, n5 / price - 1 AS return_5, n21 / price - 1 AS return_21
    FROM e LEFT JOIN b ON b.event_id = e.event_id LEFT JOIN p ON p.user_id = e.user_id AND p.ts = b.base_ts""",
    "base_price return_1 return_5 return_21",
)
def evt_03(spark, d):
    e = company_events(spark, d)
    prices = e.where("event_type <> 'signup'").select("instrument_id", F.col("event_time").alias("ts"), F.col("value").alias("close"))
    return events.market_reaction(e.where("event_type = 'signup'"), prices)
