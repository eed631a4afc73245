"""When something happened and since when it was known.

Deviation on purpose: a value with date precision becomes available at the end of its day, whether it came as a date or
as a string; ``effective_time`` never stands in for availability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_TIME = ("event_date", "announcement_date", "trade_date", "timestamp", "observation_date", "published_at", "observed_at")
EFFECTIVE_TIME = ("ex_date", "effective_date")
AVAILABILITY = (("published", "published_at"), ("received", "received_at"), ("observed", "observed_at"), ("retrieved", "retrieved_at"))
DOCUMENTS = ("company_document", "filing", "document_asset", "regulatory_document")


def instant(df: DataFrame, name: str, conservative: bool = False) -> Column:
    """A column as an instant; a date is its midnight, or its last microsecond if ``conservative``."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.DateType) and conservative:
        return c.cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return c.cast("timestamp")


def first_present(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [instant(df, n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp")


def with_envelope(df: DataFrame, conservative: bool = True) -> DataFrame:
    """Adds event_time, effective_time, available_at, basis and precision."""
    at, basis, precision = F.lit(None).cast("timestamp"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, column in reversed([x for x in AVAILABILITY if x[1] in df.columns]):
        there = F.col(column).isNotNull()
        kind = "date" if isinstance(df.schema[column].dataType, T.DateType) else "instant"
        at = F.when(there, instant(df, column, conservative)).otherwise(at)
        basis, precision = F.when(there, F.lit(name)).otherwise(basis), F.when(there, F.lit(kind)).otherwise(precision)
    return df.select(
        "*", first_present(df, EVENT_TIME).alias("event_time"), first_present(df, EFFECTIVE_TIME).alias("effective_time"),
        at.alias("available_at"), basis.alias("basis"), precision.alias("precision"),
    )


def visible_at(as_of: Column, strict: bool = True) -> Column:
    """Unknown availability is visible only if not strict; a mere retrieval is never visible if strict."""
    known = (F.col("available_at") <= as_of) & (~(F.col("basis") == "retrieved") if strict else F.lit(True))
    return F.coalesce(known, F.lit(not strict))


def point_in_time(df: DataFrame, as_of: Column, instrument=None, strict: bool = True) -> DataFrame:
    found = df.where(visible_at(as_of, strict))
    return found if instrument is None else found.where(F.col("instrument_id") == F.lit(instrument))


def known_order() -> list[Column]:
    return [F.col("event_time").asc_nulls_last(), F.col("available_at").asc_nulls_last(), F.col("record_type").asc(), F.col("record_id").asc()]


def numbered(df: DataFrame, order: list[Column], at: str = "event_time", key: str = "instrument_id", then: str | None = None) -> DataFrame:
    """``df`` with each row's position among those of its key, by ``order``, which begins with ``at`` and, if named, ``then``
    (nulls last).

    Rows are ordered within a day of a key only; what days before hold is added from counts by day, so a key that most
    rows share is spread over its days. Rows without ``at`` come after all others, by the days of ``then``."""
    last = F.lit("9999-12-31").cast("date")
    day = F.struct(F.col(at).isNull().alias("undated"), F.coalesce(F.col(at).cast("date"), *([F.col(then).cast("date")] if then else []), last).alias("day"))
    rows = df.withColumn("_day", day)
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(key).alias("_key"), F.col("_day").alias("_on"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_on")))
    within = F.row_number().over(Window.partitionBy(key, "_day").orderBy(*order))
    return placed.select(*df.columns, (F.col("_before") + within).cast("long").alias("position"))


def what_was_known(df: DataFrame, as_of: Column) -> DataFrame:
    """Visible records with their position in each instrument's story."""
    return numbered(point_in_time(df, as_of), known_order(), then="available_at")


def events_between(df: DataFrame, start: Column, end: Column, types: tuple[str, ...] = (), known_by_end: bool = False) -> DataFrame:
    found = df.where(F.col("event_time").between(start, end))
    found = found.where(F.col("record_type").isin(*types)) if types else found
    return found.where(F.col("available_at") <= end) if known_by_end else found


def documents_available(df: DataFrame, as_of: Column) -> DataFrame:
    return point_in_time(df, as_of).where(F.col("record_type").isin(*DOCUMENTS))


def by_instrument(df: DataFrame, one: str = "instrument_id", many: str = "instrument_ids") -> DataFrame:
    """A row for each instrument that a record names, in its own column or in its list."""
    ids = F.array_distinct(F.array_compact(F.array_append(F.coalesce(F.col(many), F.array()), F.col(one))))
    return df.withColumn(one, F.explode(ids)).drop(many)


def known_counts(df: DataFrame, start: Column, end: Column, days: int = 7) -> DataFrame:
    """How many records of each instrument were known at each of a series of instants, ``days`` days apart.

    Each record is counted once at the first instant at which it is visible, which is arithmetic on its time, and running
    sums do the rest: one shuffle by instrument, instead of a join of all instants with all records."""
    step = days * 86_400_000_000
    since = F.unix_micros("available_at") - F.unix_micros(start)
    number = F.greatest(F.ceil(since / F.lit(step)), F.lit(0))
    first = F.timestamp_micros(F.unix_micros(start) + number * F.lit(step))
    new = df.where((F.col("basis") != "retrieved") & F.col("available_at").isNotNull()).withColumn("as_of", first).where(F.col("as_of") <= end)
    new = new.groupBy("instrument_id", "as_of").agg(F.count(F.lit(1)).alias("new"))
    grid = F.sequence(start, end, F.make_dt_interval(F.lit(days)))
    all_times = new.select("instrument_id").distinct().withColumn("as_of", F.explode(grid))
    w = Window.partitionBy("instrument_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return all_times.join(new, ["instrument_id", "as_of"], "left").select(
        "instrument_id", "as_of", F.coalesce(F.sum("new").over(w), F.lit(0)).alias("known")
    )


# ---- what was known at many instants ----

#: Days from the first day that the cover of intervals knows, and its levels: 2**20 days.
FIRST_DAY, LEVELS = 2**19, 20


def versions(df: DataFrame, key: tuple[str, ...], strict: bool = True) -> DataFrame:
    """``df`` (with ``with_envelope``'s columns and record_id) with known_from and known_to, the time over which a record was the
    last known of its key: from its availability to that of the next one, or for good (null). Of records available at the
    same instant only the last (by record_id) is ever seen. What is never visible has no row.

    The next record is sought within the day first, then among the first ones of later days, so that a key that most rows
    share is spread over its days."""
    known = df.where(F.col("available_at").isNotNull() & ((F.col("basis") != "retrieved") if strict else F.lit(True)))
    rows = known.withColumn("_day", F.col("available_at").cast("date"))
    within = Window.partitionBy(*key, "_day").orderBy("available_at", "record_id")
    first = rows.groupBy(*key, "_day").agg(F.min("available_at").alias("_first"))
    later = F.lead("_first").over(Window.partitionBy(*key).orderBy("_day"))
    days = first.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(key)), F.col("_day").alias("_on"), later.alias("_later"))
    same = F.col("_day") == F.col("_on")
    for n, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    following = F.coalesce(F.lead("available_at").over(within), F.col("_later"))
    found = rows.join(days, same).withColumn("known_to", following)
    return found.select(*df.columns, F.col("available_at").alias("known_from"), "known_to").where("known_to IS NULL OR known_to > known_from")


def _day_number(at: Column) -> Column:
    return (F.unix_date(at.cast("date")) + FIRST_DAY).cast("int")


def cover(first: Column, last: Column) -> Column:
    """The blocks (level, number) of 2**level days, aligned, of which the days ``first`` to ``last`` consist: two a level at
    most."""
    block = "array<struct<level:int,number:int>>"
    start = F.struct(first.cast("int").alias("lo"), (last + 1).cast("int").alias("hi"), F.array().cast(block).alias("blocks"))

    def add(s: Column, level: Column) -> Column:
        low, high = (s["lo"] < s["hi"]) & (s["lo"] % 2 == 1), (s["lo"] < s["hi"]) & (s["hi"] % 2 == 1)
        one = lambda number: F.struct(level.cast("int").alias("level"), number.cast("int").alias("number"))
        none = F.array().cast(block)
        both = F.concat(s["blocks"], F.when(low, F.array(one(s["lo"]))).otherwise(none), F.when(high, F.array(one(s["hi"] - 1))).otherwise(none))
        lo, hi = s["lo"] + low.cast("int"), s["hi"] - high.cast("int")
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), both.alias("blocks"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, add, lambda s: s["blocks"])


def known_at(found: DataFrame, questions: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """For each question (as_of, and columns of ``key`` if it asks of some only) the version of each key that was the last known
    at that instant: the rows of ``versions`` with the columns of the question.

    An interval join without comparing ranges: the days of a version are cut into aligned blocks of 1, 2, 4, ... days, two of
    a size at most, a question looks for the one block of each size that holds its day, and both meet in an equi-join;
    exact times are compared within the first and last day only. A version costs the logarithm of its length, so one
    valid for good is no heavier than a short one."""
    asked = [c for c in key if c in questions.columns]
    until = F.coalesce(_day_number(F.col("known_to")), F.lit(2**LEVELS - 2))
    blocks = found.withColumn("_b", F.explode(cover(_day_number(F.col("known_from")), until)))
    blocks = blocks.withColumn("_level", F.col("_b.level")).withColumn("_number", F.col("_b.number")).drop("_b")
    of = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.cast("int").alias("_level"), F.floor(_day_number(F.col("as_of")) / F.pow(F.lit(2.0), k)).cast("int").alias("_number")))
    probes = questions.withColumn("_p", F.explode(of)).select(*questions.columns, "_p.*")
    # a question has a probe of each level, which no estimate of its table's size tells: never sent whole to all tasks
    met = blocks.join(probes.hint("merge") if asked else probes, [*asked, "_level", "_number"])
    return met.where("as_of >= known_from AND (known_to IS NULL OR as_of < known_to)").drop("_level", "_number")
