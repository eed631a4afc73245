"""Price bars and other inputs with hand-computed results."""

import datetime as dt

BASE = dt.datetime(2026, 1, 1)
BAR = "instrument_id string, ts timestamp, open double, high double, low double, close double, volume double, traded_value double, delivery_percent double"


def bars(spark, closes, instrument="i", base=BASE):
    rows = [(instrument, base + dt.timedelta(days=k), c - 1.0, c + 2.0, c - 2.0, float(c), 1000.0 + 100 * k, (1000.0 + 100 * k) * c, 35.0 + k) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def values(df, column, order="ts"):
    return [r[column] for r in df.orderBy(order).collect()]
