"""Price records of any spelling, and what results were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import finite

#: Fields of a price record, the first with a number counts; fields of its time, likewise.
FIELDS: dict[str, tuple[str, ...]] = {
    "close": ("close", "Close", "last_price", "ltp"),
    "open": ("open", "Open"),
    "high": ("high", "High"),
    "low": ("low", "Low"),
    "volume": ("volume", "Volume", "total_traded_quantity"),
    "traded_value": ("traded_value", "tradedValue", "total_traded_value", "turnover"),
    "delivery_quantity": ("delivery_quantity", "delivery_qty", "DELIV_QTY", "deliverable_quantity"),
    "delivery_percent": ("delivery_percent", "DELIV_PER", "delivery_percentage"),
}
TIMES = ("timestamp", "observation_date", "trade_date", "date")
ENVELOPE_TIMES = ("event_time", "observed_at", "published_at")


def number_of(payload: str, *names: str) -> Column:
    """The first of the fields that is a finite number, or text of one; truth values are none."""
    value = lambda n: F.get_json_object(payload, f"$['{n}']")
    return F.coalesce(*(F.when(~value(n).isin("true", "false", ""), finite(value(n).try_cast("double"))) for n in names))


def price_records(records: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """(…, ts, close, open, high, low, volume, traded_value, delivery_quantity, delivery_percent) of records with the price
    fields as JSON: the payload's own time first, then those of the envelope. Records without a time or a close go."""
    own = [F.try_to_timestamp(F.trim(F.get_json_object(payload, f"$.{n}"))) for n in TIMES]
    around = [F.col(c).cast("timestamp") for c in ENVELOPE_TIMES if c in records.columns]
    rows = records.select(*keep, F.coalesce(*own, *around).alias("ts"), *(number_of(payload, *names).alias(n) for n, names in FIELDS.items()))
    return rows.where("ts IS NOT NULL AND close IS NOT NULL")


def lineage(used: DataFrame, links: DataFrame, observed: DataFrame) -> DataFrame:
    """(result_id, kind, id, position) of what each result was made of: its records in their order, then each observation of
    these records once, then each raw artifact of these once, where they first come.

    ``used`` (result_id, record_id, position), ``links`` (record_id, observation_id, place), ``observed`` (observation_id, raw_ref).
    Everything stays rows, so a result of any size is no large value."""
    kept = used.where("record_id IS NOT NULL")
    records = kept.select("result_id", F.lit("record").alias("kind"), F.col("record_id").alias("id"), F.struct("position", F.lit(0).alias("place")).alias("at"))
    found = kept.join(links, "record_id").select("result_id", "observation_id", F.struct("position", F.col("place").cast("int").alias("place")).alias("at"))
    raw = found.join(observed.where("raw_ref IS NOT NULL"), "observation_id")
    first = lambda rows, kind, c: rows.groupBy("result_id", F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")).agg(F.min("at").alias("at"))
    every = records.withColumn("id", F.col("id").cast("string")).unionByName(first(found, "observation", "observation_id")).unionByName(first(raw, "raw", "raw_ref"))
    return every.select("result_id", "kind", "id", F.col("at.position").alias("position"), F.col("at.place").alias("place"))
