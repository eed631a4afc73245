"""Recursive means: what the windows of a series sort."""

from quantloom.operators import indicators, market
from tests.helpers import bars


def test_a_series_is_sorted_twice_at_most(spark):
    """Once by time, once by block; each further sort would hold all rows of a task again."""
    rows = bars(spark, range(1, 60))
    for df in (market.technical_indicators(rows), indicators.directional_movement(rows), market.exponential_averages(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and plan.count("Sort [") <= 2
