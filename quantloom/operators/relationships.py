"""Mixed records to a graph of facts: nodes, edges and the evidence of edges, from a table of rules by record type.

One scan expands each record to the nodes and edges that its type states; merging is by mergeable aggregates, so that an
instrument that a third of all records name is combined before the shuffle. Labels and metadata of merged nodes and
edges don't depend on the order of input rows: a label that says more than the id wins, then the longest, then the first in
alphabetical order; of several values of a key of the metadata that of the last record (by ``order_col``, then by value)
counts. Evidence stays rows, as an edge's may be unbounded; edges carry its count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.graph import relationship_id

#: The predicate from a company to a record of a type that has no rule of its own.
PREDICATES = {
    "PriceBar": "has_price_observation",
    "MarketQuote": "has_market_quote",
    "FundamentalSnapshot": "has_financial_snapshot",
    "CompanyPeer": "has_peer",
    "ShareholdingSnapshot": "has_shareholding",
    "CorporateAction": "has_corporate_action",
    "CompanyEvent": "has_event",
    "InsiderTransaction": "has_insider_transaction",
    "LargeDeal": "has_large_deal",
    "Filing": "has_filing",
    "CompanyDocument": "has_document",
    "DocumentAsset": "has_document_asset",
    "XBRLFact": "has_xbrl_fact",
    "NewsItem": "has_news",
    "SocialPost": "has_social_post",
    "SectorClassification": "has_classification",
    "IndexSnapshot": "has_index_snapshot",
    "IndexPriceBar": "has_index_price",
    "IndexValuationSnapshot": "has_index_valuation",
    "MacroObservation": "has_macro_observation",
    "RegulatoryItem": "has_regulatory_item",
    "RegulatoryDocument": "has_regulatory_document",
    "MacroSeries": "has_macro_series",
    "MacroRelease": "has_macro_release",
}
#: Fields that name a record, the preferred one first.
IDS = (
    "record_id", "event_id", "asset_id", "filing_id", "document_id", "news_id", "social_id", "index_id",
    "observation_id", "relationship_id", "series_id", "instrument_id",
)
#: Types of records about an index, that of its constituents first.
INDEX = ("indexconstituent", "indexsnapshot", "indexpricebar", "indexvaluationsnapshot")
NODE = "struct<node_id:string,node_type:string,label:string,instrument_id:string,metadata:map<string,string>>"
EDGE = "struct<subject_id:string,predicate:string,object_id:string,valid_from:string,metadata:map<string,string>>"


def plain(kind: Column) -> Column:
    """``PriceBar`` and ``price_bar`` alike."""
    return F.lower(F.replace(kind, F.lit("_"), F.lit("")))


def _field(records: DataFrame) -> Callable[[str], Column]:
    """A field of a record as text: its column, else that member of its JSON ``payload``; empty counts as null."""
    dtypes = dict(records.dtypes)

    def get(name: str) -> Column:
        found = [F.nullif(F.col(f"`{name}`").cast("string"), F.lit(""))] if name in dtypes and not dtypes[name].startswith("array") else []
        if dtypes.get("payload") == "string":
            found.append(F.nullif(F.get_json_object("payload", f"$.{name}"), F.lit("")))
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return get


def _list(records: DataFrame, name: str) -> Column:
    """A list of texts: a column, else that member of the payload."""
    dtypes, none = dict(records.dtypes), F.array().cast("array<string>")
    found = [F.col(name).cast("array<string>")] if dtypes.get(name, "").startswith("array") else []
    if dtypes.get("payload") == "string":
        found.append(F.from_json(F.get_json_object("payload", f"$.{name}"), "array<string>"))
    return F.filter(F.coalesce(*found, none), lambda x: x.isNotNull() & (x != ""))


def stated(records: DataFrame, order_col: str, include_data_records: bool = True) -> DataFrame:
    """(order, source, evidence, nodes, edges) of each record."""
    get, kind = _field(records), plain(F.col("record_type"))
    only = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    # what several rules ask for is read from a record once
    records = records.select(
        "*", kind.alias("_kind"), F.coalesce(*(get(n) for n in IDS)).alias("_rid"),
        F.array_distinct(F.array_compact(F.array_prepend(_list(records, "instrument_ids"), get("instrument_id")))).alias("_instruments"),
        only(get("index_id"), *INDEX).alias("_index"), only(get("index_symbol"), *INDEX).alias("_symbol"), only(_list(records, "assets"), "filing").alias("_assets"),
        only(get("filing_id"), "documentasset").alias("_filing"), only(get("regulatory_id"), "regulatorydocument").alias("_regulatory"),
    )
    kind, rid, instruments, index, symbol, assets, filing, regulatory = (F.col(f"_{n}") for n in ("kind", "rid", "instruments", "index", "symbol", "assets", "filing", "regulatory"))
    iid = F.get(instruments, 0)
    nothing = F.create_map().cast("map<string,string>")

    def about(key: str, value: Column) -> Column:
        return F.when(value.isNull(), nothing).otherwise(F.create_map(F.lit(key), value)).cast("map<string,string>")

    def node(prefix: str, of: Column, label: Column | None = None, instrument: Column | None = None, metadata: Column = nothing, node_type: str | None = None) -> Column:
        of_what = F.lit(None).cast("string") if instrument is None else instrument
        return F.struct(
            F.concat(F.lit(f"{prefix}:"), of).alias("node_id"), F.lit(node_type or prefix).alias("node_type"), F.coalesce(label, of).alias("label") if label is not None else of.alias("label"),
            of_what.alias("instrument_id"), metadata.alias("metadata"),
        ).cast(NODE)

    def edge(subject: Column, predicate: Column | str, target: Column, valid_from: Column | None = None, metadata: Column = nothing) -> Column:
        since = F.lit(None).cast("string") if valid_from is None else valid_from
        says = F.lit(predicate) if isinstance(predicate, str) else predicate
        return F.struct(subject.alias("subject_id"), says.alias("predicate"), target.alias("object_id"), since.alias("valid_from"), metadata.alias("metadata")).cast(EDGE)

    def to(prefix: str, of: Column) -> Column:
        return F.concat(F.lit(f"{prefix}:"), of)

    def companies() -> Column:
        return F.transform(instruments, lambda i: node("company", i, instrument=i))

    def from_companies(predicate: Column | str, target: Column, of: Column = instruments) -> Column:
        return F.transform(of, lambda i: edge(to("company", i), predicate, target))

    record = F.concat(F.lit("record:"), F.col("record_type"), F.lit(":"), rid)

    def record_node(label: Column, instrument: Column | None = None) -> Column:
        one = F.struct(record.alias("node_id"), F.lit("record").alias("node_type"), label.alias("label"), (F.lit(None).cast("string") if instrument is None else instrument).alias("instrument_id"), about("record_type", F.col("record_type")).alias("metadata"))
        return F.array(one.cast(NODE))

    none_n, none_e = F.array().cast(f"array<{NODE}>"), F.array().cast(f"array<{EDGE}>")
    data = F.lit(include_data_records)
    first = F.slice(instruments, 1, 1)  # at most one
    predicate = F.element_at(F.create_map(*(F.lit(x) for t, p in PREDICATES.items() for x in (t.lower(), p))), kind)
    label = F.coalesce(get("name"), get("symbol"), iid)
    #: (record types, condition, nodes, edges); the first rule of a type counts
    rules = [
        (("instrument",), iid.isNotNull(), F.array(node("instrument", iid, label, iid), node("company", iid, label, iid)), F.array(edge(to("company", iid), "has_instrument", to("instrument", iid)))),
        (
            INDEX[:1], index.isNotNull() & (F.size(instruments) > 0),
            F.concat(F.array(node("index", index, symbol)), F.transform(instruments, lambda i: node("instrument", i, instrument=i))),
            F.transform(instruments, lambda i: edge(to("index", index), "contains_instrument", to("instrument", i), get("effective_date"), about("index_symbol", symbol))),
        ),
        (
            INDEX[1:], rid.isNotNull() & index.isNotNull(),
            F.concat(F.array(node("index", index, symbol)), F.when(data, record_node(rid)).otherwise(none_n)),
            F.when(data, F.array(edge(to("index", index), "has_index_record", record))).otherwise(none_e),
        ),
        (
            ("companydocument",), rid.isNotNull() & iid.isNotNull(),
            F.array(node("company", iid, instrument=iid), node("document", rid, get("title"), iid, about("document_type", get("document_type")))),
            F.array(edge(to("company", iid), "has_document", to("document", rid))),
        ),
        (
            ("filing",), rid.isNotNull(),
            F.concat(F.array(node("filing", rid, get("filing_type"), iid)), F.transform(first, lambda i: node("company", i, instrument=i)), F.transform(assets, lambda a: node("document_asset", a, instrument=iid))),
            F.concat(from_companies("has_filing", to("filing", rid), first), F.transform(assets, lambda a: edge(to("filing", rid), "has_document_asset", to("document_asset", a)))),
        ),
        (
            ("documentasset",), rid.isNotNull(),
            F.concat(F.array(node("document_asset", rid, get("title"), iid)), F.when(filing.isNotNull(), F.array(node("filing", filing, instrument=iid))).otherwise(none_n)),
            F.when(filing.isNotNull(), F.array(edge(to("filing", filing), "has_document_asset", to("document_asset", rid)))).otherwise(from_companies("has_document_asset", to("document_asset", rid), first)),
        ),
        (
            ("regulatoryitem",), rid.isNotNull(), F.concat(F.array(node("regulatory", rid, get("title"))), companies()),
            from_companies("has_regulatory_item", to("regulatory", rid)),
        ),
        (
            ("regulatorydocument",), rid.isNotNull(),
            F.concat(F.array(node("regulatory_document", rid, get("title"))), F.when(regulatory.isNotNull(), F.array(node("regulatory", regulatory))).otherwise(companies())),
            F.when(regulatory.isNotNull(), F.array(edge(to("regulatory", regulatory), "has_document", to("regulatory_document", rid)))).otherwise(from_companies("has_regulatory_item", to("regulatory_document", rid))),
        ),
        (("newsitem",), rid.isNotNull(), F.concat(F.array(node("news", rid, get("title"))), companies()), from_companies("has_news", to("news", rid))),
        (
            (), rid.isNotNull() & data,
            F.concat(record_node(F.coalesce(get("title"), get("subject"), get("event_type"), rid), iid), F.when(predicate.isNotNull(), companies()).otherwise(none_n)),
            F.when(predicate.isNotNull(), from_companies(predicate, record)).otherwise(none_e),
        ),
    ]
    nodes, edges = F.when(kind.isNull(), none_n), F.when(kind.isNull(), none_e)
    for types, fits, its_nodes, its_edges in rules:
        mine = kind.isin(*types) if types else F.lit(True)
        nodes = nodes.when(mine, F.when(fits, its_nodes).otherwise(none_n))
        edges = edges.when(mine, F.when(fits, its_edges).otherwise(none_e))
    evidence = F.array_sort(F.array_distinct(F.array_compact(F.array_prepend(_list(records, "source_observation_ids"), get("raw_ref")))))
    return records.select(F.col(order_col).alias("order"), get("source").alias("source"), evidence.alias("evidence"), nodes.alias("nodes"), edges.alias("edges"))


def _mapped(last: Column) -> Column:
    """A map of the last values ((k, last)) of the keys: as many as there are different keys."""
    entries = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", last.alias("v")))))
    return F.map_from_entries(entries.cast("array<struct<k:string,v:string>>"))


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """Without the rows of empty lists. ``inline`` would leave them out as well, but first, by working out each list once
    more for a filter on its size."""
    return rows.where(F.col(name).isNotNull())


def nodes_of(facts: DataFrame) -> DataFrame:
    """(node_id, node_type, label, instrument_id, metadata): a row for each node of the facts of ``stated``."""
    rows = _listed(facts.select("order", F.inline_outer("nodes")), "node_id").select("*", F.explode_outer("metadata").alias("k", "v"))
    bare = F.element_at(F.split("node_id", ":", 2), -1)
    better = F.struct(F.col("label").isin(F.col("node_id"), bare).alias("bare"), (-F.length("label")).alias("short"), "label")
    own = lambda label: (F.min("node_type").alias("node_type"), F.min(label).alias("better"), F.min("instrument_id").alias("instrument_id"))
    # the facts are read once: a row for each node and key of its metadata, then one for each node
    keyed = rows.groupBy("node_id", "k").agg(*own(better), F.max(F.struct("order", "v")).alias("last"))
    merged = keyed.groupBy("node_id").agg(*own(F.col("better")), _mapped(F.col("last.v")).alias("metadata"))
    return merged.select("node_id", "node_type", F.col("better.label").alias("label"), "instrument_id", "metadata")


def _edge_rows(facts: DataFrame) -> DataFrame:
    rows = _listed(facts.select("order", "source", "evidence", F.inline_outer("edges")), "subject_id")
    return rows.withColumn("relationship_id", relationship_id(F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("valid_from")))


def edges_of(facts: DataFrame) -> DataFrame:
    """(relationship_id, subject_id, predicate, object_id, valid_from, source, n_evidence, metadata): a row for each edge. Its
    source is ``multiple`` where there are several, which are then listed in the metadata."""
    key = ["subject_id", "predicate", "object_id", "valid_from"]
    item = "array<struct<k:string,v:string,evidence_id:string>>"
    none = F.lit(None).cast("string")
    said = F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), none.alias("evidence_id"))).cast(item)
    shown = F.transform("evidence", lambda e: F.struct(none.alias("k"), none.alias("v"), e.alias("evidence_id"))).cast(item)
    rows = _listed(facts.select("order", "source", "evidence", F.inline_outer("edges")), "subject_id").select("order", "source", F.xxhash64(*key).alias("first"), *key, F.inline_outer(F.concat(said, shown)))
    # the facts are read once: a row for each edge and piece of evidence or key of its metadata, then one for each edge
    # sorts look at a hash first, as most ids begin alike
    keyed = rows.groupBy("first", *key, "k", "evidence_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max(F.struct("order", "v")).alias("last"))
    merged = keyed.groupBy("first", *key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.count("evidence_id").alias("n_evidence"), _mapped(F.col("last.v")).alias("known"),
    )
    several = F.size("sources") > 1
    known = F.col("known")
    listed = F.map_concat(F.map_filter(known, lambda k, _: k != "sources"), F.create_map(F.lit("sources"), F.array_join("sources", ",")))
    return merged.select(
        relationship_id(*(F.col(c) for c in key)).alias("relationship_id"), *key, F.when(several, "multiple").otherwise(F.get("sources", 0)).alias("source"), "n_evidence",
        F.when(several, listed).otherwise(known).alias("metadata"),
    )


def evidence_of(facts: DataFrame) -> DataFrame:
    """(relationship_id, evidence_id): each piece of evidence of each edge once."""
    return _edge_rows(facts).select("relationship_id", F.explode("evidence").alias("evidence_id")).distinct()
