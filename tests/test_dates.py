"""Dates in all sorts of spellings, and HTML's character references, against tables and the standard library."""

import datetime as dt
import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from quantloom.sources import dates, exchange, parsers, references

D = dt.date(2024, 3, 5)
#: Spellings of one day.
SAME = (
    "2024-03-05", "2024/03/05", "2024.3.5", "2024-3-5", "05-03-2024", "05/03/2024", "5.3.2024", "5 3 2024", "05-03-24", "5/3/24", "5 Mar 2024", "05-Mar-2024", "05-MAR-2024", "5-mar-24", "05 March 2024",
    "5th March 2024", "5th of March, 2024", "5th of march 2024", "March 5, 2024", "March 5th, 2024", "Mar 5 2024", "MAR. 5, 2024", "Mar-05-2024", "2024 Mar 5", "2024-Mar-05", "2024, March 5th", "20240305",
    "05Mar2024", "5mar24", "Tuesday, 5 March 2024", "Tue 05 Mar 2024", "as on 05-MAR-2024", "dated the 5th of March 2024 at Mumbai", "on 5/3/2024 it was", "(05-Mar-2024)", "2024-03-05T00:00:00", "2024-03-05 10:20",
    "05-Mar-2024 16:10:00", "05-Mar-2024 4:10 PM", "16:10:00 05-Mar-2024", "Tue, 05 Mar 2024 10:20:30 +0000", "2024-03-05T10:20:30Z", "2024-03-05T10:20:30.123456+05:30", "20240305 1530", "20240305T153000",
    "  5 Mar 2024  ", "5 Mar, 2024", "5,Mar,2024", "5 Mar '24", "March 5 '24",
)
NULL = (
    "", " ", "-", "None", "nan", "NaT", "null", "N/A", "Q1 FY24", "hello", "12:30", "31-Feb-2024", "30/02/2024", "2024-13-40", "0", "5", "123456", "May", "5 May", "05/2024/03", "13/13/2024", "99", "a2024b", "2024-00-10",
    "32 Jan 2024", "Marchand 2024 5",
)
PARTS = {
    "Mar 2024": (2024, 3, 1), "March 2024": (2024, 3, 1), "MAR-2024": (2024, 3, 1), "Mar-24": (2024, 3, 1), "Mar '24": (2024, 3, 1), "2024 March": (2024, 3, 1), "2024-Mar": (2024, 3, 1), "2024-03": (2024, 3, 1), "2024/3": (2024, 3, 1),
    "03/2024": (2024, 3, 1), "3-2024": (2024, 3, 1), "2024": (2024, 1, 1), "quarter ended Mar 2024": (2024, 3, 1), "3/25/2024": (2024, 3, 25), "03-25-24": (2024, 3, 25), "25/3/99": (1999, 3, 25), "25/3/75": (2075, 3, 25),
    "25/3/76": (1976, 3, 25), "1 sept 2023": (2023, 9, 1), "29 Feb 2024": (2024, 2, 29), "31.12.1999": (1999, 12, 31), "1st June 2001": (2001, 6, 1), "2nd June 2001": (2001, 6, 2), "3rd July 2001": (2001, 7, 3),
}
TIMES = {
    "05-Mar-2024 16:10:00": (2024, 3, 5, 16, 10), "05-Mar-2024 4:10 PM": (2024, 3, 5, 16, 10), "05-Mar-2024 12:05 am": (2024, 3, 5, 0, 5), "05-Mar-2024 12:05 p.m.": (2024, 3, 5, 12, 5), "2024-03-05T10:20:30Z": (2024, 3, 5, 10, 20, 30),
    "2024-03-05T10:20:30+05:30": (2024, 3, 5, 4, 50, 30), "2024-03-05 10:20:30 -0800": (2024, 3, 5, 18, 20, 30), "Tue, 05 Mar 2024 10:20:30 GMT": (2024, 3, 5, 10, 20, 30), "Tue, 05 Mar 2024 10:20:30 IST": (2024, 3, 5, 10, 20, 30),
    "2024-03-05 10:20:30.5": (2024, 3, 5, 10, 20, 30, 500_000), "2024-03-05 10:20:30,123": (2024, 3, 5, 10, 20, 30, 123_000), "20240305 1530": (2024, 3, 5, 15, 30), "20240305T153045": (2024, 3, 5, 15, 30, 45), "5 March 2024": (2024, 3, 5),
    "10:20 5/3/2024": (2024, 3, 5, 10, 20), "2024-03-05 00:30 GMT+0100": (2024, 3, 4, 23, 30),
}


def test_spellings_of_dates(spark):
    want = {s: D for s in SAME} | {s: None for s in NULL} | {s: dt.date(*d) for s, d in PARTS.items()}
    rng = random.Random(4)
    forms = ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d-%b-%Y", "%d %B %Y", "%B %d, %Y", "%b %d %Y", "%Y%m%d", "%d.%m.%y", "%Y %b %d")
    for k in range(110):
        day = dt.date(1976, 1, 1) + dt.timedelta(days=rng.randint(0, 36_000))
        want[day.strftime(forms[k % len(forms)])] = day
    assert len(want) >= 200
    found = spark.createDataFrame([(s,) for s in want] + [(None,)], "s string").select("s", dates.day(F.col("s")).alias("d")).collect()
    assert {r["s"]: r["d"] for r in found} == want | {None: None}


def test_spellings_of_times(spark):
    found = spark.createDataFrame([(s,) for s in TIMES], "s string").select("s", dates.instant(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in found} == {s: dt.datetime(*t) for s, t in TIMES.items()}
    bad = spark.createDataFrame([("5 March 2024 25:10",), ("12:10",), (None,)], "s string").select(dates.instant(F.col("s")).alias("t"))
    assert [r["t"] for r in bad.collect()] == [None] * 3


def test_references_are_those_of_the_standard_library(spark):
    rng, names = random.Random(1), list(html5)
    texts = ["caf&eacute; &#8217;s &mdash;", "&notit; &amp;amp; &ampfoo & &#0; &#128; &#x80; &#xD800; &#x110000; &#99999999999999999999; &#; &unknown; &;", "&#129;|&#11;|&#13;|&#xFFFE;|&#x1F600;|&lt", "", "plain", "&"]
    for _ in range(250):
        texts.append("".join(rng.choice(["&" + rng.choice(names), f"&#{rng.randint(0, 70_000)};", f"&#x{rng.randint(0, 1_200_000):x}", " a", "&", ";"]) for _ in range(6)))
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", references.unescaped(F.col("t")).alias("u")).collect()
    assert all(r["u"] == html.unescape(r["t"]) for r in found)


def test_quotes_are_read_one_by_one(spark):
    text = '{"data":{"A":{"ltp":"1,005.5","ohlc":7,"live_ohlc":{"open":1},"timestamp":"never","last_trade_time":"x"},"B":[1],"C":null,"D":{}}}'
    df = spark.createDataFrame([(text,), (None,), ("no",), ('{"data":[]}',)], "payload string")
    at = F.lit("2024-01-01").cast("timestamp")
    found = {r["instrument_key"]: r for r in parsers.quotes(df, retrieved_at=at).collect()}
    assert set(found) == {"A", "D"} and (found["A"]["last_price"], found["A"]["day_open"], found["A"]["timestamp"]) == (1005.5, 1.0, dt.datetime(2024, 1, 1))
    assert found["D"]["bid_depth"] == [] and found["D"]["order_count"] == 0
    assert sorted(r["instrument_key"] for r in parsers.not_quotes(df).collect()) == ["B", "C"]


def test_rows_of_deals_and_members(spark):
    deals = spark.createDataFrame([('{"BULK_DEALS_DATA":[{"symbol":"a","qty":"1,000","date":"02-Oct-2026"},{"symbol":"a","qty":"1,000","date":"02-Oct-2026"}],"SHORT_DEALS_DATA":[]}',), (None,)], "t string")
    found = exchange.large_deals(deals, "bulk_deals", "t").collect()
    assert len(found) == 2 and found[0]["event_id"] == found[1]["event_id"] and found[0]["trade_date"] == dt.date(2026, 10, 2)
    assert exchange.large_deals(deals, "short_deals", "t").count() == 0 and exchange.large_deals(deals, "block_deals", "t").count() == 0
    members = exchange.index_constituents(spark.createDataFrame([('{"data":[{"x":1},{"ticker":"b ","index":"I"}]}',)], "t string"), "t").collect()
    assert [(r["rank"], r["symbol"], r["index_symbol"], r["instrument_id"]) for r in members] == [(2, "B", "I", None)]
