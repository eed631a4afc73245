"""Named enrichments over a bundle of tables. Spark plans the work; this only says which tables an enrichment reads.

``enrich`` is lazy: it returns a DataFrame for each enrichment whose tables are there, and rows of issues for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from quantloom.operators import comparative, events, fundamentals, market, ownership, regimes

Enrichment = tuple[tuple[str, ...], Callable[..., DataFrame]]

ENRICHMENTS: dict[str, Enrichment] = {
    "market.simple_return": (("prices",), market.simple_return),
    "market.return_summary": (("prices",), market.return_summary),
    "market.returns": (("prices",), market.returns),
    "market.return_horizons": (("prices",), market.return_horizons),
    "market.rolling_volatility": (("prices",), market.rolling_volatility),
    "market.volatility_summary": (("prices",), market.volatility_summary),
    "market.drawdown": (("prices",), market.drawdown_summary),
    "market.moving_averages": (("prices",), market.moving_averages),
    "market.liquidity": (("prices",), market.liquidity),
    "market.multi_resolution": (("prices",), market.multi_resolution),
    "market.technical_indicators": (("prices",), market.technical_indicators),
    "market.relative_performance": (("prices", "benchmark"), market.relative_performance),
    "comparative.benchmark": (("prices", "benchmark"), comparative.benchmark_comparison),
    "comparative.peer_returns": (("prices", "peers"), comparative.peer_returns),
    "fundamental.growth": (("statements",), fundamentals.growth),
    "fundamental.ttm": (("statements",), fundamentals.trailing),
    "fundamental.profitability": (("statements",), fundamentals.profitability),
    "fundamental.solvency": (("statements",), fundamentals.solvency),
    "fundamental.cashflow": (("statements",), fundamentals.cash_flow),
    "ownership.shareholding_changes": (("shareholding",), ownership.shareholding_changes),
    "ownership.insider_activity": (("insider",), ownership.insider_activity),
    "ownership.large_deals": (("deals",), ownership.large_deals),
    "events.company_summary": (("events",), events.company_summary),
    "events.market_reaction": (("events", "prices"), events.market_reaction),
    "regime.historical_state": (("prices",), regimes.historical_state),
    "regime.trend_state": (("prices",), regimes.trend_state),
    "regime.volatility_state": (("prices",), regimes.volatility_state),
    "regime.extremes": (("prices",), regimes.extremes),
    "regime.persistence": (("prices",), regimes.persistence),
}
PROFILES: dict[str, tuple[str, ...]] = {
    "market": tuple(n for n in ENRICHMENTS if n.startswith("market.") and n != "market.relative_performance"),
    "comparative": ("market.relative_performance", "comparative.benchmark", "comparative.peer_returns"),
    "fundamental": tuple(n for n in ENRICHMENTS if n.startswith("fundamental.")),
    "ownership": tuple(n for n in ENRICHMENTS if n.startswith("ownership.")),
    "events": tuple(n for n in ENRICHMENTS if n.startswith("events.")),
    "regime": tuple(n for n in ENRICHMENTS if n.startswith("regime.")),
    "complete": tuple(ENRICHMENTS),
}


def enrich(spark: SparkSession, tables: dict[str, DataFrame], names: Iterable[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """({enrichment: result}, issues (enrichment, code, missing)); a profile's name stands for its enrichments."""
    wanted = dict.fromkeys(n for name in names for n in PROFILES.get(name, (name,)))
    if unknown := [n for n in wanted if n not in ENRICHMENTS]:
        raise KeyError(f"no such enrichment: {unknown}")
    found, issues = {}, []
    for name in wanted:
        needs, function = ENRICHMENTS[name]
        missing = [t for t in needs if t not in tables]
        if missing:
            issues.append((name, "missing_capability", ",".join(missing)))
        else:
            found[name] = function(*(tables[t] for t in needs))
    return found, spark.createDataFrame(issues, "enrichment string, code string, missing string")
