import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import canonical, graph, identity, quality, reconcile, records, temporal
from tests.helpers import one

DAY = dt.datetime(2026, 1, 1)


def status(spark, *pairs, **options):
    df = spark.createDataFrame([("e", "close", s, v, f"{s}{k}") for k, (s, v) in enumerate(pairs)], "entity_key string, field string, source string, value string, observation_id string")
    return one(reconcile.reconciled(df, **options)), df


@pytest.mark.parametrize(
    ("pairs", "options", "want"),
    [
        ([("a", "100"), ("b", "100.005")], {}, "agree"),
        ([("a", "100"), ("b", "100.5")], {"tolerance": 0.001, "minor": 0.01}, "minor_difference"),
        ([("a", "100"), ("b", "120")], {}, "conflicting"),
        ([("a", "100"), ("b", "100")], {"expected": ("a", "b", "third")}, "missing"),
        ([("a", "N/A"), ("b", "unknown")], {}, "unresolvable"),
    ],
)
def test_reconciliation(spark, pairs, options, want):
    result, df = status(spark, *pairs, **options)
    assert result["status"] == want
    chosen = reconcile.chosen(df, reconcile.reconciled(df, **options), priority=("b",)).collect()
    assert [r["source"] for r in chosen] == (["b"] if want in ("agree", "minor_difference") else [])


def test_dedup_keeps_last_or_first_with_null_keys(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("k", "c", 3), ("k", "d", 4)], "key string, v string, seq long")
    assert {r["v"] for r in records.one_of_each(df, ("key",), F.col("seq")).collect()} == {"b", "d"}
    assert {r["v"] for r in records.one_of_each(df, ("key",), F.col("seq"), "first").collect()} == {"a", "c"}


def test_alias_validity(spark):
    d = dt.date
    names = spark.createDataFrame([("X", "i1", None, d(2025, 12, 31)), ("X", "i2", d(2026, 1, 1), None), ("Y", "i1", None, None), ("Y", "i2", None, None)], "norm string, instrument_id string, valid_from date, valid_to date")
    asked = spark.createDataFrame([(1, "x ", d(2025, 12, 31)), (2, "X", d(2026, 1, 1)), (3, "y", d(2026, 1, 1)), (4, "z", d(2026, 1, 1))], "request_id long, name string, as_of date")
    out = {r["request_id"]: (r["status"], r["instrument_id"]) for r in identity.resolved_at(asked, names).collect()}
    assert out == {1: ("ok", "i1"), 2: ("ok", "i2"), 3: ("ambiguous", None), 4: ("unknown", None)}


def test_visibility(spark):
    at = lambda h, m=0: DAY + dt.timedelta(hours=h, minutes=m)
    df = spark.createDataFrame([("a", "news", "i", at(9), None), ("b", "news", "i", at(10), None), ("c", "news", "i", None, at(8))], "record_id string, record_type string, instrument_id string, published_at timestamp, retrieved_at timestamp")
    df, now = temporal.with_envelope(df), F.lit(at(9, 30))
    assert {r["record_id"] for r in temporal.point_in_time(df, now).collect()} == {"a"}
    assert {r["record_id"] for r in temporal.point_in_time(df, now, strict=False).collect()} == {"a", "c"}
    dated = temporal.with_envelope(spark.createDataFrame([("d", dt.date(2026, 1, 1))], "record_id string, published_at date"))
    assert one(dated)["available_at"] == dt.datetime(2026, 1, 1, 23, 59, 59, 999999)


def test_quality_findings(spark):
    df = spark.createDataFrame([(1, "s", DAY, DAY - dt.timedelta(hours=1), float("nan"), '{"a":1}'), (2, "s", DAY, DAY, 1.0, '{"a":1,"b":[1]}')], "id long, source string, published_at timestamp, retrieved_at timestamp, v double, j string")
    found = [
        quality.timestamp_anomalies(df, "id"), quality.invalid_numbers(df, "id"), quality.stale_sources(df, F.lit(DAY + dt.timedelta(days=3)), 2, "id"),
        quality.duplicates(df, ("source",), "id"), quality.schema_drift(df.withColumn("g", quality.json_signature(F.col("j"))), ("source",), "g", "id", "id"),
    ]
    assert [f.count() for f in found] == [1, 1, 2, 1, 1]
    assert found[-1].collect()[0]["detail"] == "+b:array,b[]:number -"
    assert not quality.report(*found).first()["passed"] and quality.report(found[2]).first()["passed"]


def test_evidence_chain(spark):
    held = spark.createDataFrame([("r1", ["o1"]), ("r2", ["o2", "o9"])], "record_id string, observation_ids array<string>")
    seen = spark.createDataFrame([("o1", "r1", "w1"), ("o2", "rx", "w2")], "observation_id string, canonical_record_id string, raw_ref string")
    raw = spark.createDataFrame([("w1",)], "raw_ref string")
    assert sorted(r["problem"] for r in canonical.evidence_gaps(held, seen, raw).collect()) == ["missing_observation", "missing_raw", "other_record"]
    with pytest.raises(ValueError, match="broken"):
        canonical.assert_evidence(held, seen, raw)
    canonical.assert_evidence(held.where("record_id = 'r1'"), seen.where("observation_id = 'o1'"), raw)


def test_edges_merge_evidence(spark):
    facts = spark.createDataFrame([("a", "issues", "b", "e1", "s1"), ("a", "issues", "b", "e2", "s2"), ("b", "part_of", "c", "e3", "s1")], "subject string, predicate string, object string, evidence string, source string")
    edges = graph.merged_edges(facts)
    assert {(r["subject"], r["n_evidence"], r["source"]) for r in edges.collect()} == {("a", 2, "multiple"), ("b", 1, "s1")}
    assert {(r["node"], r["distance"]) for r in graph.within_hops(edges, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.outgoing(edges, "a").count() == 1 and graph.incoming(edges, "c", "part_of").count() == 1


def test_undated_records_are_placed_by_their_availability(spark):
    at = lambda d: None if d is None else dt.datetime(2024, 1, d)
    rows = [(1, at(3), at(4)), (2, None, at(9)), (3, None, at(2)), (4, None, None), (5, at(1), None), (6, None, at(2)), (7, at(3), at(3))]
    df = spark.createDataFrame([("i", "t", r, e, a, "observed") for r, e, a in rows], "instrument_id string, record_type string, record_id int, event_time timestamp, available_at timestamp, basis string")
    placed = temporal.numbered(df, temporal.known_order(), then="available_at")
    assert [r["record_id"] for r in placed.orderBy("position").collect()] == [5, 7, 1, 3, 6, 2, 4]
    assert [r["position"] for r in placed.orderBy("position").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_names_at_an_instant_match_all_pairs(spark):
    """every request met every instrument of its name."""
    rng = random.Random(5)
    day = lambda: rng.choice([None, *(dt.date(2024, 1, k) for k in range(1, 12))])
    names = [(rng.choice("AB"), f"i{rng.randrange(6)}", day(), day()) for _ in range(25)]
    asked = [(k, rng.choice("abC"), day()) for k in range(80)]
    found = identity.resolved_at(spark.createDataFrame(asked, "request_id int, name string, as_of date"), spark.createDataFrame(names, "norm string, instrument_id string, valid_from date, valid_to date"))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("valid_" in line for line in joins)
    got = {r["request_id"]: (r["status"], r["instrument_id"]) for r in found.collect()}
    for k, name, at in asked:
        own = {i for n, i, a, b in names if n == name.upper() and (a is None or (at is not None and a <= at)) and (b is None or (at is not None and at <= b))}
        assert got[k] == (("unknown", None) if not own else ("ambiguous", None) if len(own) > 1 else ("ok", min(own)))
