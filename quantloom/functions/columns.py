"""Column expressions that several operator families share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is 0."""
    return F.try_divide(a, b)


def change(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1


def history(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("instrument_id",))).orderBy(order)


def last_rows(spec: WindowSpec, n: int) -> WindowSpec:
    return spec.rowsBetween(1 - n, 0)


def full_window(value: Column, spec: WindowSpec, n: int, counted: Column) -> Column:
    """``value`` over the last ``n`` rows, null until there are ``n``."""
    return F.when(F.count(counted).over(last_rows(spec, n)) == n, value.over(last_rows(spec, n)))


def compounded(r: Column) -> Column:
    """Product of (1 + r) less 1, for r above -1."""
    return F.exp(F.sum(F.log1p(r))) - 1


def days_between(end: Column, start: Column) -> Column:
    """Days as a fraction of the exact time between two instants."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)


def finite(x: Column) -> Column:
    """A number that is neither NaN nor infinite, else null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def content_id(*parts: Column) -> Column:
    """SHA-256 of parts joined by '|'; null parts are left out."""
    return F.sha2(F.concat_ws("|", *parts), 256)
