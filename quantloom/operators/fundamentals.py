"""Financial statements: metric names, merged periods, growth, trailing sums and ratios.

Deviation on purpose: periods are told apart by instrument, period end and period type, and growth never compares a
quarter with a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import ratio
from quantloom.operators import nested

#: Fixed values, in their order: names under which statements carry a concept.
CONCEPTS: dict[str, tuple[str, ...]] = {
    "revenue": ("revenue", "total revenue", "revenue from operations", "net sales", "sales", "operating revenue"),
    "gross_profit": ("gross profit",),
    "ebitda": ("ebitda", "earnings before interest tax depreciation and amortization"),
    "ebit": ("ebit", "operating profit", "operating income", "profit from operations"),
    "ebt": ("profit before tax", "pbt", "ebt", "profit before income tax"),
    "net_income": ("profit after tax", "pat", "net profit", "net income", "profit attributable to owners", "profit attributable to shareholders"),
    "eps": ("eps", "earning per share", "earnings per share", "diluted eps", "basic eps"),
    "total_assets": ("total assets",),
    "current_assets": ("current assets",),
    "current_liabilities": ("current liabilities",),
    "inventory": ("inventory", "inventories"),
    "cash": ("cash and cash equivalents", "cash equivalents", "cash & cash equivalents", "cash"),
    "total_equity": ("total equity", "shareholders equity", "shareholder equity", "total shareholders equity", "equity attributable to owners"),
    "total_debt": ("total debt", "total borrowings", "borrowings", "interest bearing debt", "debt"),
    "interest_expense": ("interest expense", "finance costs", "finance cost", "interest and finance charges"),
    "operating_cash_flow": ("operating cash flow", "cash flow from operations", "net cash from operating activities", "cash generated from operations"),
    "capital_expenditure": ("capital expenditure", "capex", "purchase of property plant and equipment", "purchase of fixed assets", "purchase of property plant equipment"),
    "free_cash_flow": ("free cash flow",),
    "tax_expense": ("tax expense", "income tax expense", "taxation"),
}
GROWTH = ("revenue", "gross_profit", "ebitda", "ebit", "net_income", "operating_cash_flow", "eps")
FLOWS = ("revenue", "ebitda", "ebit", "net_income", "operating_cash_flow", "capital_expenditure")
PERIOD = ("instrument_id", "period_end", "period_type")


def normal_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def resolved_metrics(long: DataFrame, also: tuple[str, ...] = PERIOD, order_col: str | None = None) -> DataFrame:
    """(…, concept, value, name) from long statements (…, name, value): the first alias if a name is exactly that, else the
    first name (by ``order_col``) that is one of the aliases; else, alias by alias, the shortest name that ends with it as
    words, then the first in alphabetical order. A name's value is the last one given.

    Every name meets the fixed alias table by its word endings, in an equi-join."""
    rows = [(concept, " ".join("".join(x if x.isalnum() else " " for x in alias).split()), k) for concept, names in CONCEPTS.items() for k, alias in enumerate(names)]
    known = F.broadcast(long.sparkSession.createDataFrame(rows, "concept string, alias string, alias_place int"))
    order = F.col(order_col) if order_col else F.lit(0)
    keyed = long.withColumn("key", normal_key(F.col("name"))).where("value IS NOT NULL AND key <> ''")
    keyed = keyed.groupBy(*also, "key").agg(F.max_by("value", F.struct(order, "value")).alias("value"), F.min(order).alias("_order"))
    words = F.split("key", " ")
    endings = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, k, F.size(words)), " "))
    hits = keyed.select("*", F.posexplode(endings).alias("cut", "alias")).join(known, "alias")
    exact = F.col("cut") == 0
    rank = F.struct(
        (~exact).alias("loose"),
        F.when(exact, (F.col("alias_place") > 0).cast("int")).otherwise(F.col("alias_place")).alias("alias_place"),
        F.when(exact, F.col("_order")).alias("given"),
        F.when(~exact, F.length("key")).alias("length"),
        "key",
    )
    return hits.groupBy(*also, "concept").agg(F.min_by(F.struct("value", "key"), rank).alias("m")).select(*also, "concept", "m.value", F.col("m.key").alias("name"))


def flat_metrics(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    """(…, name, value, place) of the numeric leaves of nested JSON, to any depth: keys on the way are joined, ``value`` stands
    for what is around it, lists add nothing to the name, numbers may be text. ``place`` orders the leaves as they came. Of
    leaves of one name the last counts. What else is named like ``value``, and all below it, is left out."""
    leaves = nested.json_leaves(payloads, text, *keep)
    number = F.col("node").try_cast("double")
    own = F.when(F.try_element_at("path", F.lit(-1)) == "value", F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))
    rows = leaves.select(*keep, own.alias("own"), number.alias("value"), "place").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) <> double('Infinity')")
    # keys are read one by one only where one may be named like that
    joined = F.array_join("own", " ")
    rows = rows.where(~F.when(F.lower(joined).contains("value"), F.exists("own", lambda x: normal_key(x) == "value")).otherwise(False))
    rows = rows.select(*keep, normal_key(joined).alias("name"), "value", "place").where("name <> ''")
    return rows.groupBy(*keep, "name").agg(F.max_by("value", "place").alias("value"), F.min("place").alias("place"))


def financial_points(records: DataFrame) -> DataFrame:
    """(instrument_id, period_end, period_type, statement_name, statement_type, record_id, available_at, concept, value, name)
    of statement records (record_id, instrument_id, payload as JSON, available_at). Records without a period end or a
    metric give none."""
    get = lambda *names: F.coalesce(*(F.get_json_object("payload", f"$.{n}") for n in names))
    label = F.trim(get("period_end", "period", "period_label"))
    whole = F.coalesce(F.try_to_date(label, "yyyy-MM-dd"), F.try_to_date(label, "dd-MM-yyyy"))
    month = F.coalesce(F.try_to_date(label, "MMM yyyy"), F.try_to_date(label, "MMMM yyyy"))
    period = records.select(
        "record_id", "instrument_id", "available_at",
        F.coalesce(whole, F.last_day(month)).alias("period_end"),
        *(F.lower(get("period_type")).alias("period_type"), get("statement_name").alias("statement_name"), get("statement_type").alias("statement_type")),
    ).where("period_end IS NOT NULL")
    flat = flat_metrics(records.select("record_id", get("metrics").alias("metrics")), "metrics", "record_id")
    return period.join(resolved_metrics(flat, ("record_id",), "place"), "record_id")


def period_values(points: DataFrame) -> DataFrame:
    """(instrument_id, period_end, period_type, statement_type, concept, value, record_id, available_at, period_available_at):
    per period the first record (by statement, then record) that has the concept, when that record was available, and when
    all records of the period were."""
    key = ("instrument_id", "period_end", "period_type", "statement_type")
    order = F.struct("statement_name", "record_id")
    known = points.groupBy(*key, "concept").agg(F.min_by(F.struct("value", "record_id", "available_at"), order).alias("m"), F.max("available_at").alias("_last"))
    latest = F.max("_last").over(Window.partitionBy(*key))
    return known.withColumn("period_available_at", latest).select(*key, "concept", "m.*", "period_available_at")


def merged_periods(long: DataFrame, concepts: tuple[str, ...] = tuple(CONCEPTS)) -> DataFrame:
    """One row for each period with a column for each concept; the first value by ``seq`` counts."""
    order = F.struct("seq", "value")
    pick = [F.min_by(F.when(F.col("concept") == c, F.col("value")), F.when((F.col("concept") == c) & F.col("value").isNotNull(), order)).alias(c) for c in concepts]
    return long.groupBy(*PERIOD).agg(*pick)


def period_number(end: Column, kind: Column) -> Column:
    return F.when(kind == "quarterly", F.year(end) * 4 + F.quarter(end)).otherwise(F.year(end))


def long_metrics(statements: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(instrument, period end, type, number, metric, value) of the metrics that a statement has."""
    metrics = tuple(m for m in metrics if m in statements.columns)
    rows = statements.select(*PERIOD, *(F.col(m).cast("double").alias(m) for m in metrics))
    long = rows.unpivot(list(PERIOD), list(metrics), "metric", "value").where("value IS NOT NULL")
    return long.withColumn("number", period_number(F.col("period_end"), F.col("period_type")))


def metric_history():
    return Window.partitionBy("instrument_id", "period_type", "metric").orderBy("period_end")


def growth(statements: DataFrame, metrics: tuple[str, ...] = GROWTH) -> DataFrame:
    """Change over the period before, and over the same quarter of the year before; only across unbroken periods."""
    w = metric_history()
    rows = long_metrics(statements, metrics)
    lags = F.filter(
        F.array(*(F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("prev"), F.lag("number", k).over(w).alias("before")) for k in (1, 4))),
        lambda x: (x["lag"] == 1) | (F.col("period_type") == "quarterly"),
    )
    rows = rows.withColumn("lags", lags).withColumn("x", F.explode("lags")).select("*", "x.*")
    basis = F.when((F.col("lag") == 1) & (F.col("period_type") == "quarterly"), "qoq").otherwise("yoy")
    found = rows.where((F.col("prev") != 0) & (F.col("number") - F.col("before") == F.col("lag")))
    return found.select(*PERIOD, "metric", basis.alias("basis"), (F.col("value") / F.col("prev") - 1).alias("growth"))


def period_gaps(statements: DataFrame, metrics: tuple[str, ...] = GROWTH) -> DataFrame:
    """Issues of ``growth``: neighbouring rows of a metric with periods missing between them."""
    rows = long_metrics(statements, metrics).withColumn("before", F.lag("number").over(metric_history()))
    return rows.where(F.col("number") - F.col("before") != 1).select(*PERIOD, "metric", F.lit("period_gap").alias("code"))


def trailing(statements: DataFrame, metrics: tuple[str, ...] = FLOWS, quarters: int = 4) -> DataFrame:
    """Sums over four consecutive quarters that all have the metric."""
    w = metric_history()
    frame = w.rowsBetween(1 - quarters, 0)
    rows = long_metrics(statements, metrics).where("period_type = 'quarterly'")
    rows = rows.withColumn("n", F.count("value").over(frame)).withColumn("ttm", F.sum("value").over(frame))
    rows = rows.withColumn("first", F.min("number").over(frame))
    return rows.where((F.col("n") == quarters) & (F.col("number") - F.col("first") == quarters - 1)).select("instrument_id", "period_end", "metric", "ttm")


def missing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with a null column for each of ``names`` that it lacks, so that ratios come out null."""
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def profitability(statements: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument_id", "period_type").orderBy("period_end")
    s = missing(statements, "revenue", "gross_profit", "ebitda", "ebit", "net_income", "total_equity", "total_assets")
    average = lambda c: (F.col(c) + F.lag(c).over(w)) / 2
    return s.select(
        *PERIOD,
        *(ratio(F.col(c), F.col("revenue")).alias(n) for c, n in (("gross_profit", "gross_margin"), ("ebitda", "ebitda_margin"), ("ebit", "ebit_margin"), ("net_income", "net_margin"))),
        ratio(F.col("net_income"), average("total_equity")).alias("roe"),
        ratio(F.col("net_income"), average("total_assets")).alias("roa"),
    )


def solvency(statements: DataFrame) -> DataFrame:
    s = missing(statements, "total_debt", "total_equity", "cash", "ebitda", "current_assets", "current_liabilities", "inventory", "ebit", "interest_expense")
    return s.select(
        *PERIOD,
        ratio(F.col("total_debt"), F.col("total_equity")).alias("debt_to_equity"),
        ratio(F.col("total_debt") - F.col("cash"), F.col("ebitda")).alias("net_debt_to_ebitda"),
        ratio(F.col("current_assets"), F.col("current_liabilities")).alias("current_ratio"),
        ratio(F.col("current_assets") - F.col("inventory"), F.col("current_liabilities")).alias("quick_ratio"),
        ratio(F.col("ebit"), F.abs("interest_expense")).alias("interest_coverage"),
    )


def cash_flow(statements: DataFrame) -> DataFrame:
    s = missing(statements, "operating_cash_flow", "capital_expenditure", "free_cash_flow", "revenue", "net_income")
    s = s.withColumn("fcf", F.coalesce("free_cash_flow", F.col("operating_cash_flow") - F.abs("capital_expenditure")))
    return s.select(
        *PERIOD,
        F.col("fcf").alias("free_cash_flow"),
        ratio(F.col("operating_cash_flow"), F.col("revenue")).alias("operating_cash_flow_margin"),
        ratio(F.col("fcf"), F.col("revenue")).alias("free_cash_flow_margin"),
        ratio(F.col("operating_cash_flow"), F.col("net_income")).alias("cash_conversion"),
        ratio(F.abs("capital_expenditure"), F.col("revenue")).alias("capital_intensity"),
    )


#: What ``extended_ratios`` divides: name -> (upper, lower) of statement columns or of ratios found before.
QUOTIENTS = {
    "asset_turnover": ("revenue", "total_assets"), "inventory_turnover": ("cost_of_revenue", "inventory"), "receivables_turnover": ("revenue", "receivables"),
    "working_capital_turnover": ("revenue", "working_capital"), "cash_ratio": ("cash", "current_liabilities"), "operating_cash_ratio": ("operating_cash_flow", "current_liabilities"),
    "current_ratio": ("current_assets", "current_liabilities"), "debt_to_assets": ("total_debt", "total_assets"), "debt_to_equity": ("total_debt", "total_equity"),
    "gross_margin": ("gross_profit", "revenue"), "operating_margin": ("ebit", "revenue"), "ebitda_margin": ("ebitda", "revenue"), "net_margin": ("net_income", "revenue"),
    "return_on_equity": ("net_income", "total_equity"), "return_on_assets": ("net_income", "total_assets"), "return_on_capital": ("ebit", "capital_employed"),
    "equity_per_share": ("total_equity", "shares"), "earnings_per_share": ("net_income", "shares"), "revenue_per_share": ("revenue", "shares"), "cash_flow_per_share": ("free_cash_flow", "shares"),
    "cash_flow_yield": ("free_cash_flow", "market_cap"), "price_to_earnings": ("market_cap", "net_income"), "price_to_book": ("market_cap", "total_equity"), "price_to_sales": ("market_cap", "revenue"),
    "value_to_ebitda": ("enterprise_value", "ebitda"), "value_to_revenue": ("enterprise_value", "revenue"), "interest_coverage": ("ebit", "interest_paid"), "debt_to_capital": ("total_debt", "capital"),
    "payout_ratio": ("dividends", "net_income"), "quick_ratio": ("quick_assets", "current_liabilities"),
}
CHANGES = ("revenue", "net_income", "total_equity", "free_cash_flow", "ebit", "ebitda", "earnings_per_share")


def extended_ratios(statements: DataFrame) -> DataFrame:
    """Turnovers, days, margins, returns, coverage, per-share and market ratios, and changes on the absolute base, for the
    latest period of each instrument and period type. Columns that the statements lack give null ratios."""
    w = Window.partitionBy("instrument_id", "period_type").orderBy("period_end")
    inputs = sorted({x for pair in QUOTIENTS.values() for x in pair} - {"working_capital", "quick_assets", "capital_employed", "enterprise_value", "interest_paid", "capital"})
    s = missing(statements, *inputs, "interest_expense").withColumns(
        {
            "free_cash_flow": F.coalesce("free_cash_flow", F.col("operating_cash_flow") - F.abs("capital_expenditure") if "capital_expenditure" in statements.columns else F.lit(None)),
            "working_capital": F.col("current_assets") - F.col("current_liabilities"),
            "quick_assets": F.col("current_assets") - F.col("inventory"),
            "capital_employed": F.col("total_assets") - F.col("current_liabilities"),
            "enterprise_value": F.col("market_cap") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)),
            "interest_paid": F.abs("interest_expense"),
            "capital": F.col("total_debt") + F.col("total_equity"),
        }
    )
    found = s.select(*PERIOD, *dict.fromkeys(c for c in CHANGES if c in s.columns), *(ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in QUOTIENTS.items() if n not in CHANGES), ratio(F.col("net_income"), F.col("shares")).alias("earnings_per_share"))
    days = {n: ratio(F.lit(365.0), F.col(turned)) for n, turned in (("inventory_days", "inventory_turnover"), ("collection_days", "receivables_turnover"))}
    found = found.withColumns(days).withColumn("cash_cycle_days", F.col("inventory_days") + F.col("collection_days"))
    changes = {f"{c}_change": ratio(F.col(c) - F.lag(c).over(w), F.abs(F.lag(c).over(w))) for c in CHANGES}
    changes["equity_per_share_change"] = ratio(F.col("equity_per_share") - F.lag("equity_per_share").over(w), F.abs(F.lag("equity_per_share").over(w)))
    rows = found.withColumns(changes).withColumn("peg_ratio", ratio(F.col("price_to_earnings"), 100 * F.col("earnings_per_share_change"))).withColumn("k", F.row_number().over(w.orderBy(F.col("period_end").desc())))
    return rows.where("k = 1").select(*PERIOD, *QUOTIENTS, *days, "cash_cycle_days", *changes, "peg_ratio")


#: Names that a snapshot's consumers know the ratios by.
SNAPSHOT_NAMES = {
    "asset_efficiency": "asset_turnover", "book_equity_growth": "equity_per_share_change", "equity_value_per_share": "equity_per_share", "cash_coverage": "cash_ratio", "liquidity_ratio": "current_ratio",
    "collection_days": "collection_days", "asset_leverage": "debt_to_assets", "leverage_ratio": "debt_to_equity", "profit_growth": "net_income_change", "profit_per_share": "earnings_per_share",
    "profit_per_share_growth": "earnings_per_share_change", "operating_ebitda_growth": "ebitda_change", "business_value_to_ebitda": "value_to_ebitda", "business_value_to_revenue": "value_to_revenue",
    "free_cash_growth": "free_cash_flow_change", "cash_flow_per_share": "cash_flow_per_share", "cash_flow_yield": "cash_flow_yield", "gross_profit_margin": "gross_margin", "interest_service_coverage": "interest_coverage",
    "inventory_efficiency": "inventory_turnover", "net_profit_margin": "net_margin", "operating_cash_liquidity": "operating_cash_ratio", "cash_conversion_cycle": "cash_cycle_days", "operating_profit_growth": "ebit_change",
    "operating_profit_margin": "operating_margin", "dividend_payout": "payout_ratio", "growth_adjusted_pe": "peg_ratio", "book_multiple": "price_to_book", "earnings_multiple": "price_to_earnings", "sales_multiple": "price_to_sales",
    "acid_test_ratio": "quick_ratio", "collection_efficiency": "receivables_turnover", "asset_return": "return_on_assets", "equity_return": "return_on_equity", "invested_capital_return": "return_on_capital",
    "sales_growth": "revenue_change", "working_capital_efficiency": "working_capital_turnover",
}


def snapshot(ratios: DataFrame) -> DataFrame:
    """The rows of ``extended_ratios`` under the names of a snapshot."""
    return ratios.select(*PERIOD, *(F.col(own).alias(name) for name, own in SNAPSHOT_NAMES.items()))


#: Fixed values: (ratio, whether larger is better, threshold, points, what is said if it passes, if not, if it is unknown); $1 stands
#: for the ratio, %1 for the ratio in per cent.
TESTS = (
    ("roe", True, 0.15, 2, "Strong ROE of %1", "Weak ROE of %1", "ROE data not available"),
    ("debt_to_equity", False, 0.5, 2, "Conservative debt levels", "High debt to equity ratio of $1", "Debt to equity data not available"),
    ("operating_margin", True, 0.15, 2, "Strong operating margins", "Weak operating margin of %1", "Operating margin data not available"),
    ("current_ratio", True, 1.5, 1, "Good liquidity position", "Weak liquidity with current ratio of $1", "Current ratio data not available"),
)


def scored(latest: DataFrame) -> DataFrame:
    """Points for four tests of the latest statement, and a reason for each, joined; a ratio that is zero or null is unknown."""
    points, reasons = F.lit(0), []
    one_digit = lambda c: F.round(c + 1e-9, 1).cast("decimal(20,1)").cast("string")
    for name, larger, limit, n, good, bad, unknown in TESTS:
        value = F.col(name)
        passed = F.coalesce((value > limit) if larger else (value < limit), F.lit(False)) & (value != 0)
        said = lambda text: F.replace(F.replace(F.lit(text), F.lit("$1"), one_digit(value)), F.lit("%1"), F.concat(one_digit(value * 100), F.lit("%")))  # noqa: B023, E731
        points = points + F.when(passed, n).otherwise(0)
        reasons.append(F.when(value.isNull() | (value == 0), F.lit(unknown)).when(passed, said(good)).otherwise(said(bad)))
    return latest.select("instrument_id", points.cast("long").alias("score"), F.concat_ws("; ", *reasons).alias("reasons"))
