"""Recursive descent, the graph of mixed records and versions known over time, by hand."""

import datetime as dt
import json
import random

from quantloom.operators import fundamentals, nested, relationships, temporal
from quantloom.plans.graph_queries import FIELDS
from quantloom.sources import exchange, xbrl


def leaves(node, path=(), place=()):
    """The same walk in plain Python."""
    if isinstance(node, dict):
        for k, (key, value) in enumerate(node.items()):
            yield from leaves(value, path + (key,), place + (-1 if key == "value" else k,))
    elif isinstance(node, list):
        for k, value in enumerate(node):
            yield from leaves(value, path, place + (k,))
    elif path or place:
        yield path, place, node


def random_json(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice(["a", "b c", "value", "Value", "é", "x.y", "n-1"]): random_json(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and kind < 0.7:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, "3", "text", None, True, '{"no": 1}', "[1", "{", ""])


def test_leaves_match_a_walk_at_any_depth(spark):
    rng = random.Random(3)
    docs = [(k, random_json(rng, rng.randint(1, 9))) for k in range(60)]
    docs.append((60, {"a": docs[5][1], "deep": [[[[[[[[[[{"x": {"y": 1}}]]]]]]]]]]}))
    rows = spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in docs] + [(98, None), (99, "no json {"), (97, " ")], "id int, t string")
    for levels in (1, 4):
        found = nested.json_leaves(rows, "t", "id", levels=levels).collect()
        text = lambda v: None if v is None else v.strip() if isinstance(v, str) else json.dumps(v)
        expected = {k: [(list(p), text(v)) for p, _, v in sorted(leaves(d), key=lambda r: r[1])] for k, d in docs if isinstance(d, (dict, list))}
        for k, own in expected.items():
            assert [(r["path"], r["node"]) for r in sorted((r for r in found if r["id"] == k), key=lambda r: r["place"])] == own
        assert {r["id"] for r in found} == {k for k, own in expected.items() if own}


def test_metrics_have_no_depth_and_keep_their_order(spark):
    payload = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}, "z": 2, "Value": 5, "q": {"value": {"k": 1}}, "many": [{"n": k} for k in range(1500)], "t": {"value": "4", "u": 9}}
    rows = spark.createDataFrame([(1, json.dumps(payload))], "id int, t string")
    found = {r["name"]: r["value"] for r in fundamentals.flat_metrics(rows, "t", "id").collect()}
    assert found == {"a b c d e f g": 1.0, "z": 2.0, "many n": 1499.0, "t": 4.0, "t u": 9.0}


def test_first_list_of_rows_at_any_depth(spark):
    shapes = {
        1: [{"s": 1}, 2, {"s": 3}], 2: {"meta": {"x": 1}, "wrap": {"inner": {"Table": [{"s": 1}]}}, "later": [{"s": 9}]}, 3: {"e": [], "w": {"data": [{"s": 1}]}},
        4: {"w": {"data": []}, "z": [{"s": 3}]}, 5: {"x": [1, 2], "y": {"z": {"k": [{"s": 7}]}}}, 6: {"records": [], "y": [{"s": 1}]}, 7: 3, 8: {"a": {"b": {}}},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in shapes.items()] + [(9, None)], "id int, t string")
    found = {}
    for r in nested.nested_rows(rows, "t", "id", keys=exchange.FILING_KEYS).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["row"]["s"])
    assert found == {1: ["1", "3"], 2: ["1"], 4: ["3"], 5: ["7"]}


def test_facts_in_tuples(spark):
    xml = (
        '<xbrl xmlns:f="urn:f"><context id="c"><period><instant>2024-01-31</instant></period></context><f:T><f:A contextRef="c">1</f:A>'
        '<f:U><f:B contextRef="c">2<f:C contextRef="c">3</f:C></f:B><f:D contextRef="c"><f:E contextRef="c">4</f:E></f:D></f:U></f:T></xbrl>'
    )
    found = xbrl.raw_facts(spark.createDataFrame([(1, xml), (2, "<xbrl/>"), (3, None), (4, "no")], "filing_id int, xml string"))
    # an element with elements and no text is none
    assert sorted((r["concept"], float(r["value"])) for r in found.collect()) == [("A", 1.0), ("B", 2.0), ("C", 3.0), ("E", 4.0)]


def mixed(spark, *rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS)


def graph_of(spark, *rows, **kwargs):
    facts = relationships.stated(mixed(spark, *({"seq": k, **r} for k, r in enumerate(rows))), "seq", **kwargs)
    edges = {(r["subject_id"], r["predicate"], r["object_id"]): r for r in relationships.edges_of(facts).collect()}
    return {r["node_id"]: r for r in relationships.nodes_of(facts).collect()}, edges, facts


def test_every_type_has_its_edges(spark):
    nodes, edges, _ = graph_of(
        spark,
        {"record_type": "Instrument", "instrument_id": "I", "name": "Name"},
        {"record_type": "NewsItem", "record_id": "n", "instrument_ids": ["I", "J", "I"], "title": "T"},
        {"record_type": "filing", "record_id": "f", "instrument_id": "I", "payload": '{"assets":["a1","a2"]}'},
        {"record_type": "DocumentAsset", "record_id": "a1", "instrument_id": "I", "title": "Report"},
        {"record_type": "DocumentAsset", "record_id": "a2", "filing_id": "f"},
        {"record_type": "IndexConstituent", "index_id": "X", "index_symbol": "XX", "instrument_id": "I"},
        {"record_type": "IndexPriceBar", "record_id": "p", "index_id": "X"},
        {"record_type": "RegulatoryDocument", "record_id": "d", "instrument_ids": ["J"]},
        {"record_type": "xbrl_fact", "record_id": "x", "instrument_id": "J"},
        {"record_type": "Unheard", "record_id": "u", "instrument_id": "J"},
        {"record_type": "MacroSeries", "payload": '{"series_id":"s"}'},
        {"record_type": "CompanyDocument", "record_id": "no instrument"},
        {"record_type": None, "record_id": "z", "instrument_id": "I"},
        {"record_type": "PriceBar"},
    )
    assert set(edges) == {
        ("company:I", "has_instrument", "instrument:I"), ("company:I", "has_news", "news:n"), ("company:J", "has_news", "news:n"), ("company:I", "has_filing", "filing:f"),
        ("filing:f", "has_document_asset", "document_asset:a1"), ("filing:f", "has_document_asset", "document_asset:a2"), ("company:I", "has_document_asset", "document_asset:a1"),
        ("index:X", "contains_instrument", "instrument:I"), ("index:X", "has_index_record", "record:IndexPriceBar:p"), ("company:J", "has_regulatory_item", "regulatory_document:d"),
        ("company:J", "has_xbrl_fact", "record:xbrl_fact:x"),
    }
    assert edges["index:X", "contains_instrument", "instrument:I"]["metadata"] == {"index_symbol": "XX"}
    assert {n: r["label"] for n, r in nodes.items() if n.split(":")[0] in ("company", "document_asset", "index")} == {
        "company:I": "Name", "company:J": "J", "document_asset:a1": "Report", "document_asset:a2": "a2", "index:X": "XX"
    }
    assert nodes["record:MacroSeries:s"]["metadata"] == {"record_type": "MacroSeries"} and nodes["record:Unheard:u"]["instrument_id"] == "J"


def test_edges_merge_evidence_sources_and_metadata(spark):
    one = {"record_type": "IndexConstituent", "index_id": "X", "instrument_id": "I", "index_symbol": "old", "source": "a", "raw_ref": "r1", "source_observation_ids": ["o", "r1"]}
    two = {**one, "index_symbol": "new", "source": "b", "raw_ref": "r2"}
    other = {**two, "effective_date": "2024-01-01"}
    for rows in ((one, two, other), (other, two, one)):
        rows = [{**r, "seq": k} for r, k in ((one, 1), (two, 2), (other, 3))] if rows[0] is one else [{**r, "seq": k} for r, k in ((other, 3), (two, 2), (one, 1))]
        facts = relationships.stated(mixed(spark, *rows), "seq")
        found = {r["valid_from"]: r for r in relationships.edges_of(facts).collect()}
        assert (found[None]["source"], found[None]["n_evidence"], found[None]["metadata"]) == ("multiple", 3, {"index_symbol": "new", "sources": "a,b"})
        assert (found["2024-01-01"]["source"], found["2024-01-01"]["n_evidence"]) == ("b", 3)
        assert {r["evidence_id"] for r in relationships.evidence_of(facts).where(f"relationship_id = '{found[None]['relationship_id']}'").collect()} == {"o", "r1", "r2"}


def test_data_records_can_be_left_out(spark):
    rows = ({"record_type": "PriceBar", "record_id": "p", "instrument_id": "I"}, {"record_type": "IndexSnapshot", "record_id": "s", "index_id": "X"})
    nodes, edges, _ = graph_of(spark, *rows, include_data_records=False)
    assert set(nodes) == {"index:X"} and not edges


def test_blocks_of_days_cover_intervals(spark):
    from pyspark.sql import functions as F

    pairs = [(a, a + n) for a in (0, 1, 7, 8, 524_288, 543_210) for n in (0, 1, 2, 5, 30, 1000)]
    for r in spark.createDataFrame(pairs, "a int, b int").select("a", "b", temporal.cover(F.col("a"), F.col("b")).alias("c")).collect():
        days = sorted(day for level, number in r["c"] for day in range(number << level, (number + 1) << level))
        assert days == list(range(r["a"], r["b"] + 1))
        assert max(sum(level == k for level, _ in r["c"]) for k in range(20)) <= 2


def test_last_known_version_at_each_instant(spark):
    rng = random.Random(9)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(k, f"i{rng.randint(0, 2)}", rng.choice(["a", "b", None]), at(rng.choice([rng.randint(0, 60_000), 5000, 7200])), rng.choice(["observed", "observed", "retrieved"])) for k in range(150)]
    rows.append((150, "i0", "a", None, "observed"))
    df = spark.createDataFrame(rows, "record_id int, instrument_id string, record_type string, available_at timestamp, basis string")
    key = ("instrument_id", "record_type")
    instants = [at(m) for m in range(-100, 61_000, 777)] + [at(5000), at(7200)]
    questions = spark.createDataFrame([(t,) for t in instants], "as_of timestamp")
    found = temporal.known_at(temporal.versions(df, key), questions, key)
    expected = set()
    for t in instants:
        last = {}
        for r in sorted((r for r in rows if r[3] is not None and r[3] <= t and r[4] != "retrieved"), key=lambda r: (r[3], r[0])):
            last[r[1], r[2]] = r[0]
        expected |= {(t, i, k, r) for (i, k), r in last.items()}
    assert {(r["as_of"], r["instrument_id"], r["record_type"], r["record_id"]) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    asked = spark.createDataFrame([("i1", at(9000)), ("i9", at(9000))], "instrument_id string, as_of timestamp")
    assert {r["record_id"] for r in temporal.known_at(temporal.versions(df, key), asked, key).collect()} == {r[3] for r in _at(rows, at(9000)) if r[1] == "i1"}


def _at(rows, t):
    last = {}
    for r in sorted((r for r in rows if r[3] is not None and r[3] <= t and r[4] != "retrieved"), key=lambda r: (r[3], r[0])):
        last[r[1], r[2]] = r[0]
    return {(t, i, k, r) for (i, k), r in last.items()}


def test_descent_takes_one_pass_whatever_the_depth(spark):
    """each level was another round over the table, and another parse of all below it."""
    deep = '{"a":' * 60 + '[{"symbol":"S","n":1.50}]' + "}" * 60
    rows = spark.createDataFrame([(1, deep), (2, "{'a':{'b':'x\"y'},'c':[1,{'symbol':'t'}]} rest"), (3, '{"a":1'), (4, '{"k\\ud800":"\\ud83d\\ude00"}')], "id int, t string")
    started = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    leaves, found = nested.json_leaves(rows, "t", "id"), nested.nested_rows(rows, "t", "id", keys=exchange.FILING_KEYS)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == started
    got = {(r["id"], tuple(r["path"])): r["node"] for r in leaves.collect()}
    assert got == {(1, ("a",) * 60 + ("symbol",)): "S", (1, ("a",) * 60 + ("n",)): "1.50", (2, ("a", "b")): 'x"y', (2, ("c",)): "1", (2, ("c", "symbol")): "t", (4, ("k?",)): "\U0001f600"}
    assert [(r["id"], r["rank"], r["row"]) for r in found.collect()] == [(1, 1, {"symbol": "S", "n": "1.5"})]


def test_assets_carry_the_columns_of_their_filing(spark):
    """filings were read twice, to be joined with their own documents."""
    text = '{"data":[{"symbol":"s","xbrl":"https://x/a.xml","details":"https://d/1","S-Y-M":"x"},{"symbol":"t"}]}'
    found = exchange.filings(spark.createDataFrame([(1, text)], "id int, t string"), "results", "t", "id")
    assert [(r["id"], r["symbol"], r["position"], r["document_type"]) for r in exchange.filing_assets(found, "id", "symbol").orderBy("position").collect()] == [(1, "S", 0, "xbrl_xml"), (1, "S", 1, "unknown")]


def test_probes_of_many_questions_are_not_broadcast(spark):
    """twenty probes a question were broadcast, as their estimate was that of the questions."""
    df = spark.createDataFrame([("i", "r", dt.datetime(2024, 1, 1), "published")], "instrument_id string, record_id string, available_at timestamp, basis string")
    asked = spark.createDataFrame([("i", dt.datetime(2024, 1, 2))], "instrument_id string, as_of timestamp")
    found = temporal.known_at(temporal.versions(df, ("instrument_id",)), asked, ("instrument_id",))
    met = next(line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "_level" in line and "Join" in line)
    assert "SortMergeJoin" in met and found.count() == 1
