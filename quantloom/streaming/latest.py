"""Keep-last dedup as a stream: the last version of each key by availability, with corrections when a later one arrives.

State is kept for each key: the order of the version given out and its revision, no rows. A version that is older than what was
given out changes nothing, so files may arrive in any order; the highest revision of each key is what the batch operator
gives. A timer on the availability of the last version drops the state of keys that nothing has corrected for long."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("revision", T.IntegerType())])


def use_keyed_state(spark: SparkSession) -> None:
    """States by key need the RocksDB store; a session that has chosen a store keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class KeepLast(StatefulProcessor):
    def __init__(self, columns: list[str], keep_ms: int):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: (r["_at"], r["_tie"]))
        known = self.last.get() if self.last.exists() else None
        if known is not None and (best["_at"], best["_tie"]) <= (known[0], known[1]):
            return
        revision = 1 if known is None else known[2] + 1
        if known is not None:
            self.handle.deleteTimer(known[0] // 1000 + self.keep_ms)
        self.last.update((best["_at"], best["_tie"], revision))
        self.handle.registerTimer(best["_at"] // 1000 + self.keep_ms)
        yield Row(**{c: best[c] for c in self.columns}, revision=revision, corrects=revision > 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_of_each(stream: DataFrame, key: tuple[str, ...], time: str = "available_at", tie: str = "seq", late: str = "2 days", keep_days: int = 400) -> DataFrame:
    """The rows of ``stream`` that are the last of their key so far, by ``time`` and then ``tie`` (a whole number), with revision
    (1 for the first) and corrects (whether an earlier revision was given out). Null key parts are equal to each other; rows
    without a time or tie are left out. A key's state goes ``keep_days`` after its last version; what comes after that
    begins anew."""
    use_keyed_state(stream.sparkSession)
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("revision", T.IntegerType()), T.StructField("corrects", T.BooleanType())])
    rows = stream.where(F.col(time).isNotNull() & F.col(tie).isNotNull()).withWatermark(time, late)
    rows = rows.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_tie", F.col(tie).cast("long"))
    return rows.groupBy(*key).transformWithState(KeepLast(columns, keep_days * 86_400_000), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def settled(updates: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The last revision of each key among what a stream has given out."""
    rest = [c for c in updates.columns if c not in key]
    best = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("_row"))
    return best.select(*key, "_row.*").select(updates.columns)
