"""Which instrument a name means: aliases, unique names, resolution by precedence and at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRECEDENCE = ("isin", "instrument_key", "exchange_token", "symbol", "name")
NOT_COMPANY = ("instrument_key", "exchange_token")


def normal(value: Column) -> Column:
    return F.upper(F.trim(value))


def canonical_instrument_id(isin: str = "isin", exchange: str = "exchange", symbol: str = "symbol") -> Column:
    """ISIN, else EXCHANGE:SYMBOL, else SYMBOL; blank counts as absent."""
    there = lambda c: F.nullif(normal(F.col(c)), F.lit(""))
    return F.coalesce(there(isin), F.concat(there(exchange), F.lit(":"), there(symbol)), there(symbol))


def aliases(instruments: DataFrame, types: tuple[str, ...] = PRECEDENCE, *also: str) -> DataFrame:
    """(instrument_id, alias_type, value, norm, ...): the names of each instrument, each once."""
    pairs = F.array(*(F.struct(F.lit(t).alias("alias_type"), F.col(t).cast("string").alias("value")) for t in types if t in instruments.columns))
    rows = instruments.select("instrument_id", *also, F.inline(pairs))
    rows = rows.where(F.trim("value") != "").withColumn("norm", normal(F.col("value")))
    return rows.groupBy("instrument_id", "alias_type", "norm", *also).agg(F.min("value").alias("value"))


def merged(identities: DataFrame, fields: tuple[str, ...], times: tuple[str, ...] = ("observed_at", "published_at", "retrieved_at")) -> DataFrame:
    """One row for each instrument: the most recent one, of equally recent ones the most complete."""
    complete = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    when = F.coalesce(*(F.col(t) for t in times if t in identities.columns))
    rank = F.struct(F.coalesce(when.cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), complete, F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)))
    return identities.groupBy("instrument_id").agg(F.max_by(F.struct(*fields), rank).alias("_i")).select("instrument_id", "_i.*")


def alias_index(names: DataFrame) -> DataFrame:
    """Names with exactly one instrument."""
    g = names.groupBy("alias_type", "norm").agg(F.min("instrument_id").alias("instrument_id"), F.max("instrument_id").alias("other"))
    return g.where("instrument_id = other").drop("other")


def ambiguous(names: DataFrame) -> DataFrame:
    g = names.groupBy("alias_type", "norm").agg(F.countDistinct("instrument_id").alias("instruments"))
    return g.where("instruments > 1")


def resolved(requests: DataFrame, names: DataFrame, types: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """``requests`` with instrument_id: that of the first alias type, by precedence, whose name is unique.

    Requests are unpivoted, so one join by name serves all alias types, whatever their number."""
    types = tuple(t for t in types if t in requests.columns)
    pairs = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(t).alias("alias_type"), normal(F.col(t).cast("string")).alias("norm")) for k, t in enumerate(types)))
    asked = requests.select("request_id", F.inline(pairs)).where("norm IS NOT NULL")
    hits = asked.join(alias_index(names), ["alias_type", "norm"]).groupBy("request_id").agg(
        F.min_by(F.struct("instrument_id", "alias_type"), "rank").alias("h")
    )
    return requests.select("request_id").join(hits, "request_id", "left").select("request_id", F.col("h.instrument_id"), F.col("h.alias_type").alias("matched_by"))


#: Where a point in time comes: names valid always, questions without a time, names valid from the beginning, all that has a time.
ALWAYS, TIMELESS, BEGINNING, TIMED = range(4)


def _validity(names: DataFrame) -> DataFrame:
    """(norm, rank, instrument_id, stage, at, phase, change): when an instrument begins (1) and ends (-1) to have a name, whatever
    the number of its overlapping validities; ``rank`` numbers the instruments of a name."""
    start, end = F.col("valid_from").cast("timestamp"), F.col("valid_to").cast("timestamp")
    stage = F.when(start.isNotNull(), TIMED).when(end.isNotNull(), BEGINNING).otherwise(ALWAYS)
    both = F.array(F.struct(stage.alias("stage"), start.alias("at"), F.lit(0).alias("phase"), F.lit(1).alias("change")), F.struct(F.lit(TIMED).alias("stage"), end.alias("at"), F.lit(2).alias("phase"), F.lit(-1).alias("change")))
    there = names.where((start.isNull() | end.isNull() | (start <= end)) & F.col("norm").isNotNull() & F.col("instrument_id").isNotNull())
    points = there.select("norm", "instrument_id", F.inline(both)).where((F.col("stage") < TIMED) | F.col("at").isNotNull())
    held = F.sum("change").over(Window.partitionBy("norm", "instrument_id").orderBy("stage", "at", "phase").rowsBetween(Window.unboundedPreceding, 0))
    turns = points.withColumn("_held", held).where("_held = CASE WHEN change > 0 THEN 1 ELSE 0 END")
    rank = F.dense_rank().over(Window.partitionBy("norm").orderBy("instrument_id")).cast("decimal(38,0)")
    return turns.select("norm", rank.alias("rank"), "instrument_id", "stage", "at", "phase", "change")


def resolved_at(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request_id, status, instrument_id): requests (name, as_of) against names with validity, both ends inclusive.

    More than one instrument is ambiguous, none is unknown. Requests don't meet the instruments of their name: how many a name
    has at an instant is a running sum over its points in time, and where it is one the running sum of ranks names it. Points
    are ordered within a day of a name only; what days before hold is added."""
    asked = requests.select("request_id", normal(F.col("name")).alias("norm"), "as_of")
    turns = _validity(names)
    at = F.col("as_of").cast("timestamp")
    questions = asked.where("norm IS NOT NULL").groupBy("norm", "as_of").agg(F.lit(True).alias("asked"))
    points = turns.select("norm", "stage", "at", "phase", "change", (F.col("change") * F.col("rank")).cast("decimal(38,0)").alias("ranks")).unionByName(
        questions.select("norm", F.when(at.isNull(), TIMELESS).otherwise(TIMED).alias("stage"), at.alias("at"), F.lit(1).alias("phase"), "as_of", "asked"), allowMissingColumns=True
    )
    points = points.withColumn("_day", F.coalesce(F.col("at").cast("date"), F.lit("1970-01-01").cast("date")))
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    earlier = Window.partitionBy("norm").orderBy("stage", "_day").rowsBetween(Window.unboundedPreceding, -1)
    days = points.groupBy("norm", "stage", "_day").agg(F.sum("change").alias("change"), F.sum("ranks").alias("ranks"))
    before = days.select("norm", "stage", "_day", total("change", earlier).alias("_change"), total("ranks", earlier).alias("_ranks"))
    within = Window.partitionBy("norm", "stage", "_day").orderBy("at", "phase").rowsBetween(Window.unboundedPreceding, 0)
    placed = points.select("norm", "stage", "_day", "as_of", "asked", total("change", within).alias("_n"), total("ranks", within).alias("_r")).where("asked")
    answers = placed.join(before, ["norm", "stage", "_day"]).select("norm", "as_of", (F.col("_n") + F.col("_change")).alias("n"), (F.col("_r") + F.col("_ranks")).cast("decimal(38,0)").alias("_sum"))
    ids = turns.select("norm", F.col("rank").alias("_sum"), "instrument_id").distinct()
    answers = answers.withColumn("_sum", F.when(F.col("n") == 1, F.col("_sum"))).join(ids, ["norm", "_sum"], "left").select(F.col("norm").alias("_norm"), F.col("as_of").alias("_as_of"), "n", "instrument_id")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "unknown").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    met = asked.join(answers, (F.col("norm") == F.col("_norm")) & F.col("as_of").eqNullSafe(F.col("_as_of")), "left")
    return met.select("request_id", status.alias("status"), "instrument_id")


def company_view(names: DataFrame) -> DataFrame:
    return names.where(~F.col("alias_type").isin(*NOT_COMPANY))
