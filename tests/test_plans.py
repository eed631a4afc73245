import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.plans import company_queries, context, enrich, source_queries
from quantloom.sources import driver_tables
from tests.helpers import bars


def test_enrich_runs_what_it_can_and_tells_the_rest(spark):
    found, issues = enrich.enrich(spark, {"prices": bars(spark, [100 + k for k in range(40)])}, ["market", "comparative.benchmark", "market.returns"])
    assert set(found) == set(enrich.PROFILES["market"]) and found["market.returns"].count() == 39
    assert [tuple(r) for r in issues.collect()] == [("comparative.benchmark", "missing_capability", "benchmark")]
    with pytest.raises(KeyError):
        enrich.enrich(spark, {}, ["no.such"])


def greedy(items, sections, max_items, max_points):
    """The selection by a loop over sections and items."""
    taken, points, seen = [], 0, set()
    for s in sections:
        for kind in context.KINDS:
            for i in sorted(items):
                item_id, k, metric, n = i
                if k != kind or k not in s.kinds or item_id in seen or (s.prefixes and not metric.startswith(s.prefixes)) or len(taken) >= max_items:
                    continue
                if kind == "series":
                    wanted = min(n, s.max_points or n)
                    got = min(wanted, max_points - points)
                    if got <= 0:
                        continue
                    points += got
                taken.append((item_id, s.name, got if kind == "series" else None))
                seen.add(item_id)
    return taken


def test_selection_matches_a_greedy_loop(spark):
    items = [(f"i{k:02}", context.KINDS[k % 3], "a.x" if k % 2 else "b.y", 5 + k) for k in range(24)]
    sections = [context.Section("one", ("a",), ("summary", "series"), 8), context.Section("two", (), ("observation", "series")), context.Section("rest")]
    df = spark.createDataFrame([("i", *x) for x in items], "instrument_id string, item_id string, kind string, metric string, points long")
    for max_items, max_points in ((30, 1000), (10, 1000), (30, 40), (12, 20), (5, 0)):
        out = context.select_items(df.unionByName(df), sections, max_items, max_points).orderBy("position").collect()
        assert [(r["item_id"], r["section"], r["included_points"]) for r in out] == greedy(items, sections, max_items, max_points)


def test_packs_and_json(spark):
    items = spark.createDataFrame([("i", "a", "summary", "m", 0), ("i", "b", "series", "m", 9), ("j", "a", "summary", "m", 0)], "instrument_id string, item_id string, kind string, metric string, points long")
    selected = context.select_items(items, [context.Section("s")], 5, 50)
    ids = {r["instrument_id"]: r["pack_id"] for r in context.pack_ids(selected).collect()}
    assert len(set(ids.values())) == 2 and ids == {r["instrument_id"]: r["pack_id"] for r in context.pack_ids(selected.repartition(3)).collect()}
    header, lines = context.json_lines(spark.createDataFrame([("r1", "x", None), ("r2", "x", 2)], "record_id string, unit string, n int"))
    assert header == {"unit": "x"} and sorted(r["line"] for r in lines.collect()) == ['{"record_id":"r1"}', '{"record_id":"r2","n":2}']


def test_shape_and_lines(spark):
    df = spark.createDataFrame([("r1", "x|y\nz", "same", None), ("r2", "b", "same", None)], "record_id string, title string, unit string, gone string")
    rows, constant = context.shaped(df)
    assert rows.columns == ["title"] and constant == {"unit": "same"}
    head, lines = context.lines(rows)
    assert head.startswith("| title |") and {r["line"] for r in lines.collect()} == {r"| x\|y z |", "| b |"}
    assert context.lines(rows, "tsv")[1].count() == 2


def test_last_points(spark):
    points = bars(spark, range(10)).selectExpr("instrument_id", "'s' AS item_id", "ts", "close AS value")
    chosen = spark.createDataFrame([("i", "s", "series", 3)], "instrument_id string, item_id string, kind string, included_points long")
    assert sorted(r["value"] for r in context.last_points(points, chosen).collect()) == [7, 8, 9]


def test_whole_queries_read_every_row(spark, sf_dir):
    items = source_queries.all_items(spark, sf_dir)
    assert items.groupBy("instrument_id", "item_id").count().where("count > 1").count() == 0
    assert items.agg(F.sum("points")).first()[0] == 7 * spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert company_queries.shifted(spark, sf_dir).count() == driver_tables.statements(spark, sf_dir).count()
    queries = entry.queries()
    assert all(queries[name](spark, sf_dir).count() for name in ("ctx_01_select_all_items", "rpr_03_pack_all_text", "fnd_06_period_gaps_all"))


def test_policies_order_drop_and_open_columns(spark):
    df = spark.createDataFrame([("p", 1, ("x", 2.0), "i", "q", 7), ("r", 2, ("y", 3.0), "i", "q", 8)], "zeta string, period_end int, metrics struct<a:string,b:double>, instrument_id string, units_in string, period_start int")
    rows, header = context.by_policy(df, "FundamentalSnapshot")
    assert rows.columns == ["period_end", "period_start", "metrics.a", "metrics.b", "zeta"] and header == {"units_in": "q"}
    assert context.by_policy(df.select("zeta", "period_end"), "Unheard")[0].columns == ["zeta", "period_end"]
