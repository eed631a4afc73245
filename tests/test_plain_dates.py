"""Plain dates are read by their places: what the search for forms finds in them."""

from pyspark.sql import functions as F

from quantloom.sources import dates


def test_plain_texts_are_read_as_the_forms_read_them(spark):
    days = [f"{d:02d}{a}{m}{b}{y}" for d in (0, 1, 15, 29, 31, 32) for m in dates.MONTHS for y in (1000, 1999, 2023, 2024, 9999) for a, b in ("--", "  ", "- ")]
    whole = [f"{y}-{m:02d}-{d:02d}" for y in (1000, 1582, 2023, 2024) for m in (0, 1, 2, 12, 13) for d in (0, 1, 5, 15, 29, 31, 32)]
    months = [f"{m}{a}{y}" for m in dates.MONTHS for y in (1000, 2024) for a in " -"]
    texts = [t + c for t in [*days, *whole] for c in ("", " 16:10", " 16:10:59", "t99:99:99")] + months
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t").rlike(f"{dates.PLAIN_DATE}|{dates.PLAIN_DAY}|{dates.PLAIN_MONTH}")
    found = rows.select("t", plain.alias("plain"), dates._date(F.col("t")).alias("d"), dates._searched(F.col("t")).alias("searched"))
    wrong = [tuple(r) for r in found.where("NOT plain OR NOT d <=> searched").collect()]
    assert not wrong and found.where("d IS NULL").count() and found.where("d IS NOT NULL").count() > 1000


def test_what_is_near_a_plain_date_is_searched(spark):
    texts = ["1-mar-2024", "15-march-2024", "on 15 mar 2024", "15 mar 24", "0000-01-01", "2024-03-15x", "mar-24", "15-foo-2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(F.col("t").rlike(f"{dates.PLAIN_DATE}|{dates.PLAIN_DAY}|{dates.PLAIN_MONTH}")).count() == 0
