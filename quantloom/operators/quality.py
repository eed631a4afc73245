"""Checks of record quality. Every check gives findings (category, severity, check, subject, detail), so they union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = ("category", "severity", "subject", "detail")


def finding(df: DataFrame, category: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def presence(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, status, n): how many rows have a value and how many don't, from one pass over the rows."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in fields))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(s).alias("status"), n.alias("n")) for c in fields for s, n in (("present", F.col(c)), ("unknown", F.col("rows") - F.col(c)))))
    return counted.select(F.inline(pairs))


def missing_fields(df: DataFrame, id_col: str, required: dict[str, tuple[str, ...]] | tuple[str, ...], type_col: str = "record_type") -> DataFrame:
    """A finding for each required field that is null; ``required`` is one list or a list for each record type."""
    rules = required.items() if isinstance(required, dict) else [(None, required)]
    lacks = [F.when(F.col(c).isNull() & (F.lit(True) if kind is None else F.col(type_col) == kind), F.lit(c)) for kind, cs in rules for c in cs]
    rows = df.select(F.col(id_col).alias("_id"), F.explode(F.array_compact(F.array(*lacks))).alias("_field"))
    return finding(rows, "missing", "warning", F.col("_id"), F.col("_field"))


def stale_sources(df: DataFrame, as_of: Column, days: dict[str, int] | int, id_col: str, times=("observed_at", "published_at", "retrieved_at")) -> DataFrame:
    """Records older than their source's limit; a source without a limit is never stale."""
    limit = F.lit(days) if isinstance(days, int) else F.create_map(*(F.lit(x) for pair in days.items() for x in pair))[F.col("source")]
    seen = F.coalesce(*(F.col(t).cast("timestamp") for t in times if t in df.columns))
    age = F.timestamp_diff("SECOND", seen, as_of)
    rows = df.withColumn("_age", age).where(F.col("_age") > limit.cast("long") * 86_400)
    return finding(rows, "stale", "warning", F.col(id_col), F.col("source"))


def of_reconciliation(results: DataFrame, *keys: str) -> DataFrame:
    severity = F.when(F.col("status") == "conflicting", "error").when(F.col("status").isin("missing", "unresolvable"), "warning")
    rows = results.withColumn("_severity", severity).where("_severity IS NOT NULL")
    return rows.select(F.lit("reconciliation").alias("category"), F.col("_severity").alias("severity"), F.concat_ws("|", *keys).alias("subject"), F.col("status").alias("detail"))


def duplicates(df: DataFrame, keys: tuple[str, ...], id_col: str) -> DataFrame:
    """A finding for each key with more than one record. It names the smallest id and counts the rest: all ids of a key
    may be most of the table, so they stay rows (join back on the key to list them)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"))
    return finding(g.where("n > 1"), "duplicate", "warning", F.col("first"), F.col("n"))


def timestamp_anomalies(df: DataFrame, id_col: str) -> DataFrame:
    """Times after retrieval, and periods that start after their end."""
    there = lambda c: c in df.columns
    rules = {f"{c}_after_retrieved_at": F.col(c) > F.col("retrieved_at") for c in ("published_at", "observed_at", "received_at") if there(c) and there("retrieved_at")}
    if there("period_start") and there("period_end"):
        rules["period_start_after_period_end"] = F.col("period_start") > F.col("period_end")
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return finding(df.select(F.col(id_col).alias("_id"), F.explode(broken).alias("_rule")), "timestamp", "error", F.col("_id"), F.col("_rule"))


def json_signature(text: Column, depth: int = 6) -> Column:
    """Sorted distinct ``path:kind`` of JSON: members of objects by name, of lists the first element under ``path[]``; an empty
    object and what lies below ``depth`` levels are told by their kind. Text that isn't JSON has the empty signature."""
    entry = "array<struct<path:string,kind:string,v:variant>>"
    kind = lambda v: F.upper(F.schema_of_variant(v))
    of = lambda path, kind, v: F.struct(path.alias("path"), kind.alias("kind"), v.alias("v"))
    open_kind, nothing = F.lit(None).cast("string"), F.lit(None).cast("variant")

    def opened(e: Column) -> Column:
        members = F.map_entries(e["v"].cast("map<string,variant>"))
        named = F.transform(members, lambda m: of(F.when(e["path"] == "", m["key"]).otherwise(F.concat(e["path"], F.lit("."), m["key"])), open_kind, m["value"]))
        listed = F.concat(F.array(of(e["path"], F.lit("array"), nothing)), F.transform(F.slice(e["v"].cast("array<variant>"), 1, 1), lambda x: of(F.concat(e["path"], F.lit("[]")), open_kind, x)))
        as_it_is = F.array(of(e["path"], e["kind"], e["v"])).cast(entry)
        is_object = e["kind"].isNull() & kind(e["v"]).startswith("OBJECT") & (F.size(members) > 0)
        return F.when(is_object, named.cast(entry)).when(e["kind"].isNull() & kind(e["v"]).startswith("ARRAY"), listed.cast(entry)).otherwise(as_it_is)

    parsed = F.try_parse_json(text)
    entries = F.when(parsed.isNotNull(), F.array(of(F.lit(""), open_kind, parsed)).cast(entry))
    for _ in range(depth):
        entries = F.flatten(F.transform(entries, opened))

    def told(e: Column) -> Column:
        k = kind(e["v"])
        plain = F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(k == "STRING", "string").when(k == "BOOLEAN", "bool").when(k == "VOID", "null").otherwise("number")
        return F.concat(e["path"], F.lit(":"), F.coalesce(e["kind"], plain))

    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(entries, told))), ","), F.lit(""))


def schema_drift(df: DataFrame, group: tuple[str, ...], signature: str, seq: str, id_col: str) -> DataFrame:
    """Records whose signature differs from that of the first record (by ``seq``) of their group.

    The first of each group comes from an aggregation, and meets the records in a join that can be split."""
    first = df.groupBy(*group).agg(F.min_by(signature, seq).alias("_first"))
    rows = df.join(first, list(group)).where(F.col(signature) != F.col("_first"))
    new = F.array_except(F.split(signature, ","), F.split("_first", ","))
    gone = F.array_except(F.split("_first", ","), F.split(signature, ","))
    return finding(rows, "schema_drift", "warning", F.col(id_col), F.concat(F.lit("+"), F.array_join(new, ","), F.lit(" -"), F.array_join(gone, ",")))


def identity_ambiguity(names: DataFrame) -> DataFrame:
    from quantloom.operators.identity import ambiguous

    return finding(ambiguous(names), "identity", "error", F.concat_ws(":", "alias_type", "norm"), F.col("instruments"))


def invalid_numbers(df: DataFrame, id_col: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """NaN and infinite values of floating-point fields."""
    fields = fields or tuple(f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)))
    bad = F.array_compact(F.array(*(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in fields)))
    return finding(df.select(F.col(id_col).alias("_id"), F.explode(bad).alias("_field")), "invalid_number", "error", F.col("_id"), F.col("_field"))


def report(*findings: DataFrame) -> DataFrame:
    """(category, severity, n, passed): counts of all findings; ``passed`` if there is no error among them."""
    every = reduce(DataFrame.unionByName, findings)
    counted = every.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    errors = F.max((F.col("severity") == "error").cast("int")).over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("passed", errors == 0)
