"""What grew faster than the input, or took more passes, memory or bytes than the job needs."""

import time

import pytest

from quantloom.operators import nested, regimes, relationships
from quantloom.sources import markup
from tests.helpers import bars
from tests.test_descent_graph import mixed


def test_rows_far_down_are_not_scanned_again_at_each_level(spark):
    """each level on the way to the rows read all that is below it once more."""
    row = '{"symbol":"s","n":1.50,"w":7,"u":true,"x":null,"of":{"k":[1,-0,"\\u00e9"]},"many":[' + ",".join(["12"] * 30_000) + "]}"
    deep = '{"a":' * 900 + f"[{row}]" + "}" * 900
    rows = spark.range(8).selectExpr("id", f"concat('{deep.replace(chr(92), chr(92) * 2)}', '') AS t").repartition(4)
    nested.nested_rows(rows.limit(1), "t", "id", keys=("data",)).collect()
    started = time.time()
    found = nested.nested_rows(rows, "t", "id", keys=("data",)).collect()
    assert time.time() - started < 6
    assert [r["rank"] for r in found] == [1] * 8
    given = dict(found[0]["row"])
    assert len(given.pop("many")) == 90_001
    assert given == {"symbol": "s", "n": "1.5", "w": "7", "u": "true", "x": None, "of": '{"k":[1,0,"é"]}'}


def test_nodes_and_edges_read_the_facts_once(spark):
    """the rules ran on all records once for each thing merged."""
    one = {"record_type": "IndexConstituent", "index_id": "X", "instrument_id": "I", "index_symbol": "s", "source": "a", "raw_ref": "r", "source_observation_ids": ["o"]}
    facts = relationships.stated(mixed(spark, {**one, "seq": 1}, {**one, "seq": 2, "source": "b"}, {**one, "seq": 3, "source": "c", "raw_ref": None}, {"record_type": "Unheard", "seq": 4}), "seq")
    for found in (relationships.nodes_of(facts), relationships.edges_of(facts)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("LogicalRDD") == 1
    (edge,) = relationships.edges_of(facts).collect()
    assert (edge["source"], edge["n_evidence"], edge["metadata"]) == ("multiple", 2, {"index_symbol": "s", "sources": "a,b,c"})


def test_pages_are_read_one_by_one_from_arrow(spark):
    """a batch's pages were turned into Python's texts all at once."""
    rows = spark.createDataFrame([(k, None if k == 7 else f"<p>a{k}</p><script>x</script> b &amp; c") for k in range(450)], "page_id int, html string").coalesce(1)
    found = markup.visible_text(rows)
    assert ", 250" in next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in line)
    assert {r["page_id"]: r["text"] for r in found.collect()} == {k: "" if k == 7 else f"a{k}\nb & c" for k in range(450)}


def test_only_objects_with_a_value_are_sorted(spark, monkeypatch):
    """the members of each list and object were sorted to bring those named ``value`` to the front."""
    monkeypatch.delattr(nested, "_members")
    node = {"a": [{"b": "1"}, "2", {"Value": {"c": None}}], "d": {"e": True}}
    pairs = lambda v: tuple((k, pairs(m)) for k, m in v.items()) if isinstance(v, dict) else [pairs(m) for m in v] if isinstance(v, list) else v
    assert list(nested._leaves(pairs(node))) == [(["a", "b"], [0, 0, 0], "1"), (["a"], [0, 1], "2"), (["a", "Value", "c"], [0, 2, 0, 0], None), (["d", "e"], [1, 0], "true")]


def test_a_history_is_sorted_before_it_is_multiplied_by_lookbacks(spark):
    """each row was sorted again once for each lookback, so that a task held four histories more."""
    state = regimes.historical_state(bars(spark, [200, 100, 110, 99]), (("two", 2), ("three", 3), ("all", 9)))
    assert state._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    found = {r["horizon"]: (r["observations"], *(r[c] for c in ("cumulative_return", "best_period_return", "worst_period_return", "maximum_drawdown"))) for r in state.collect()}
    assert {k: pytest.approx(v) for k, v in found.items()} == {"two": (2, -0.1, -0.1, -0.1, -0.1), "three": (3, -0.01, 0.1, -0.1, -0.1), "all": (4, -0.505, 0.1, -0.5, -0.505)}
