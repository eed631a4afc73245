"""Candle patterns as words of a small language.

Each bar becomes a token of fixed width: direction, size of the body, of the upper and of the lower shadow, and how the body
lies to that of the bar before and to the middle of the one two bars back. The last tokens of an instrument are one string,
and a pattern is a regular expression over it, so that all patterns are told from one pass over the bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import history
from quantloom.operators.market import prepared

WIDTH, BARS = 6, 3
#: Shares of the range from which a body is small, middling and long, and a shadow is short and long.
TINY, SMALL, LONG, SHORT_SHADOW, LONG_SHADOW = 0.1, 0.35, 0.6, 0.1, 0.55
#: Patterns over the last tokens: direction (+-0), body (n none, s small, m middling, l long), upper and lower shadow (a short, b,
#: c long), place (E engulfs, I inside, G above, L below, R opens inside and closes higher, F lower), and h or l by whether
#: the close is above or below the middle of the body two bars back.
PATTERNS = {
    "doji": r".n....$",
    "hammer": r".[ns]ac..$",
    "shooting_star": r".[ns]ca..$",
    "marubozu": r".laa..$",
    "bullish_engulfing": r"-.....\+...E.$",
    "bearish_engulfing": r"\+.....-...E.$",
    "bullish_harami": r"-l....\+...I.$",
    "bearish_harami": r"\+l....-...I.$",
    "morning_star": r"-l.....[ns]..L.\+[ml]...h$",
    "evening_star": r"\+l.....[ns]..G.-[ml]...l$",
    "three_white_soldiers": r"\+[ml]....\+[ml]..R.\+[ml]..R.$",
    "three_black_crows": r"-[ml]....-[ml]..F.-[ml]..F.$",
}


def tokens(prices: DataFrame) -> DataFrame:
    """(instrument_id, ts, token)"""
    w = history()
    rows = prepared(prices).select("instrument_id", "ts", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")))
    rows = rows.withColumn("top", F.greatest("open", "close")).withColumn("bottom", F.least("open", "close")).withColumn("span", F.col("high") - F.col("low"))
    share = lambda c: F.when(F.col("span") > 0, c / F.col("span")).otherwise(F.lit(0.0))
    body = share(F.col("top") - F.col("bottom"))
    size = F.when(body <= TINY, "n").when(body <= SMALL, "s").when(body < LONG, "m").otherwise("l")
    shadow = lambda c: F.when(share(c) <= SHORT_SHADOW, "a").when(share(c) < LONG_SHADOW, "b").otherwise("c")
    was = lambda c, n=1: F.lag(c, n).over(w)
    before = F.struct(was("top").alias("top"), was("bottom").alias("bottom"), was("close").alias("close"))
    rows = rows.withColumn("p", before).withColumn("middle", (was("top", 2) + was("bottom", 2)) / 2)
    larger = (F.col("top") - F.col("bottom")) > F.col("p.top") - F.col("p.bottom")
    opened_inside = F.col("open").between(F.col("p.bottom"), F.col("p.top"))
    place = (
        F.when((F.col("top") >= F.col("p.top")) & (F.col("bottom") <= F.col("p.bottom")) & larger, "E")
        .when((F.col("top") < F.col("p.top")) & (F.col("bottom") > F.col("p.bottom")), "I")
        .when(F.col("bottom") > F.col("p.top"), "G").when(F.col("top") < F.col("p.bottom"), "L")
        .when(opened_inside & (F.col("close") > F.col("p.close")), "R").when(opened_inside & (F.col("close") < F.col("p.close")), "F").otherwise(".")
    )
    direction = F.when(F.col("close") > F.col("open"), "+").when(F.col("close") < F.col("open"), "-").otherwise("0")
    half = F.when(F.col("close") > F.col("middle"), "h").when(F.col("close") < F.col("middle"), "l").otherwise(".")
    return rows.select("instrument_id", "ts", F.concat(direction, size, shadow(F.col("high") - F.col("top")), shadow(F.col("bottom") - F.col("low")), place, half).alias("token"))


def candle_patterns(prices: DataFrame) -> DataFrame:
    """(instrument_id, ts, pattern): the patterns that end at each bar."""
    last = F.array_join(F.collect_list("token").over(history().rowsBetween(1 - BARS, 0)), "")
    rows = tokens(prices).select("instrument_id", "ts", F.lpad(last, WIDTH * BARS, "_").alias("word"))
    found = F.array_compact(F.array(*(F.when(_last_tokens("word", p).rlike("^" + p), F.lit(name)) for name, p in PATTERNS.items())))
    return rows.select("instrument_id", "ts", F.explode(found).alias("pattern"))


def _plain(pattern: str) -> str:
    """One character for each that the pattern takes."""
    out, k = "", 0
    while k < len(pattern) and pattern[k] != "$":
        if pattern[k] == "[":
            k = pattern.index("]", k)
        elif pattern[k] == "\\":
            k += 1
        out, k = out + "x", k + 1
    return out


def _last_tokens(word: str, pattern: str) -> Column:
    """As many characters of the end as the pattern takes."""
    return F.substring(F.col(word), WIDTH * BARS - len(_plain(pattern)) + 1, len(_plain(pattern)))

