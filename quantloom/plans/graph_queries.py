"""Queries of nested payloads, the graph of mixed records and what was known at many instants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import fundamentals, nested, relationships, temporal
from quantloom.plans.catalog import query
from quantloom.plans.foundation_queries import STAMPED, stamped
from quantloom.sources import exchange, xbrl
from quantloom.sources.driver_tables import read

# ---- recursive descent ----


def _nest(depth: int) -> tuple[str, str]:
    return "".join(f'{{"L{k}":[{{"k{k}":{k}}},' for k in range(depth)), "]}" * depth


_DEEP, _CLOSE = _nest(12)


@query(
    "fnd_02_deep_metrics",
    "SELECT o_orderkey, name, value FROM (SELECT o_orderkey, "
    + "array_to_string(list_transform(range(0, k + 1), lambda i: 'l' || i), ' ') || ' k' || k AS name, k::DOUBLE AS value FROM orders, range(12) AS t(k)"
    + " UNION ALL SELECT o_orderkey, array_to_string(list_transform(range(0, 12), lambda i: 'l' || i), ' ') || ' total', o_totalprice FROM orders"
    + " UNION ALL SELECT o_orderkey, 'own', o_custkey::DOUBLE FROM orders WHERE o_orderkey % 2 = 0)",
    "value",
)
def fnd_02_deep(spark, d):
    """Twelve levels of objects and lists, and flat payloads among them."""
    price = F.col("o_totalprice").cast("decimal(20,4)").cast("string")
    deep = F.concat(F.lit(_DEEP + '{"Total":{"value":"'), price, F.lit('","note":"{\\"x\\":1}"}}' + _CLOSE))
    own = F.format_string('{"Own":%d}', "o_custkey")
    o = read(spark, d, "orders")
    both = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), deep, F.lit(","), own, F.lit("]"))).otherwise(deep)
    return fundamentals.flat_metrics(o.select("o_orderkey", both.alias("t")), "t", "o_orderkey").drop("place")


@query("prs_11_nested_rows", """SELECT o_orderkey, 1 AS rank, 'S' || o_custkey AS symbol FROM orders WHERE o_orderkey % 5 <> 4
    UNION ALL SELECT o_orderkey, 2, 'T' FROM orders WHERE o_orderkey % 5 <> 4""")
def prs_11_nested(spark, d):
    """Rows at the top, under a key, some levels down, behind lists of other things, and not at all."""
    rows = '[{"symbol":"S%d"},7,{"symbol":"T"}]'
    shapes = (rows, '{"meta":[1],"Table":%s}', '{"a":{"b":{"c":{"d":{"e":{"filings":%s}}}}},"z":[{"symbol":"no"}]}', '{"a":[1,2],"b":{"n":1},"c":{"data":[]},"x":%s}', '{"e":[],"w":{"data":%s}}')
    shape = F.element_at(F.array(*(F.lit(s.replace("%s", rows)) for s in shapes)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = read(spark, d, "orders").select("o_orderkey", F.replace(shape, F.lit("%d"), F.col("o_custkey").cast("string")).alias("t"))
    return nested.nested_rows(o, "t", "o_orderkey", keys=exchange.FILING_KEYS).select("o_orderkey", "rank", F.col("row")["symbol"].alias("symbol"))


@query("prs_24_xbrl_tuples", """SELECT o_orderkey AS filing_id, concept, value, o_orderdate::DATE AS instant FROM (
    SELECT o_orderkey, o_orderdate, 'Revenue' AS concept, o_custkey + 0.25::DOUBLE AS value FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate, 'Amount', o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 'Amount', 7.0::DOUBLE FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate, 'Share', o_orderkey::DOUBLE FROM orders)""", "value")
def prs_24_tuples(spark, d):
    """Facts inside tuples inside tuples, and beside them."""
    xml = F.format_string(
        '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:f="urn:f"><context id="c"><period><instant>%s</instant></period></context><f:Revenue contextRef="c">%d.25</f:Revenue>'
        '<f:Deal><f:Amount contextRef="c">%s</f:Amount><f:Party><f:Name>x</f:Name><f:Holding contextRef="c"><f:Share contextRef="c">%d</f:Share></f:Holding></f:Party></f:Deal><f:Deal><f:Amount contextRef="c">7</f:Amount></f:Deal></xbrl>',
        F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey", F.col("o_totalprice").cast("decimal(20,4)").cast("string"), "o_orderkey",
    )
    found = xbrl.facts(read(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), xml.alias("xml")))
    return found.select("filing_id", "concept", F.col("value").cast("double").alias("value"), "instant")


# ---- graph of mixed records ----

#: Types without a rule of their own and their predicates, stated apart from the operator.
_GENERIC = (
    ("PriceBar", "has_price_observation"), ("MarketQuote", "has_market_quote"), ("FundamentalSnapshot", "has_financial_snapshot"), ("CompanyPeer", "has_peer"),
    ("ShareholdingSnapshot", "has_shareholding"), ("CorporateAction", "has_corporate_action"), ("CompanyEvent", "has_event"), ("InsiderTransaction", "has_insider_transaction"),
    ("LargeDeal", "has_large_deal"), ("XBRLFact", "has_xbrl_fact"), ("SocialPost", "has_social_post"), ("SectorClassification", "has_classification"),
    ("MacroObservation", "has_macro_observation"), ("MacroSeries", "has_macro_series"), ("MacroRelease", "has_macro_release"), ("Unheard", None),
)
FIELDS = (
    "record_type string, record_id string, instrument_id string, instrument_ids array<string>, name string, title string, filing_type string, document_type string, index_id string, index_symbol string, "
    "effective_date string, filing_id string, regulatory_id string, payload string, source string, raw_ref string, source_observation_ids array<string>, seq long"
)


def mixed_records(spark, d):
    """Records of all types made of the driver's tables."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = dict(f.rsplit(" ", 1) for f in FIELDS.split(", "))
    text = lambda fmt, c: F.format_string(fmt, c)

    def rows(df, **fields):
        one = {k: (F.lit(v) if isinstance(v, str) else v) for k, v in fields.items()}
        return df.select(*((one[n] if n in one else F.lit(None)).cast(kinds[n]).alias(n) for n in names))

    s, n, o = (read(spark, d, t) for t in ("supplier", "nation", "orders"))
    e, p, doc = (read(spark, d, t) for t in ("events", "pages", "documents"))
    company = text("S%d", F.col("o_custkey") % 50)
    order = lambda prefix: text(prefix + "%d", F.col("o_orderkey"))
    generic = F.element_at(F.array(*(F.lit(t) for t, _ in _GENERIC)), (F.col("event_id") % len(_GENERIC) + 1).cast("int"))
    parts = [
        rows(s, record_type="Instrument", instrument_id=text("S%d", "s_suppkey"), name=F.col("s_name"), source="ref", raw_ref=text("r%d", "s_suppkey"), seq=F.col("s_suppkey")),
        rows(s.join(n, s.s_nationkey == n.n_nationkey), record_type="index_constituent", instrument_ids=F.array(text("S%d", "s_suppkey")), index_id=text("N%d", "n_nationkey"), index_symbol=F.col("n_name"), effective_date="2024-01-01", source="ref", seq=F.col("s_suppkey")),
        rows(n, record_type="IndexSnapshot", record_id=text("x%d", "n_nationkey"), payload=text('{"index_id":"N%d"}', "n_nationkey"), source="nse", raw_ref=text("x%d", "n_nationkey"), seq=F.col("n_nationkey")),
        rows(o, record_type="Filing", record_id=order("F"), instrument_id=company, filing_type="Results", payload=text('{"assets":["A%d",""]}', "o_orderkey"), source="nse", raw_ref=order("f"), seq=F.col("o_orderkey")),
        rows(o, record_type="DocumentAsset", record_id=order("A"), instrument_id=company, filing_id=order("F"), title=order("Asset "), source="bse", raw_ref=order("d"), source_observation_ids=F.array(order("f"), order("o")), seq=F.col("o_orderkey")),
        rows(o, record_type="company_document", record_id=order("D"), instrument_id=company, document_type=F.col("o_orderstatus"), source="site", seq=F.col("o_orderkey")),
        rows(doc, record_type="NewsItem", record_id=text("n%d", "doc_id"), instrument_ids=F.array(text("S%d", F.col("doc_id") % 7), text("S%d", F.col("doc_id") % 11), text("S%d", F.col("doc_id") % 7)), source=F.col("source"), seq=F.col("doc_id")),
        rows(p.where("page_id % 2 = 0"), record_type="RegulatoryItem", record_id=text("%d", "page_id"), instrument_ids=F.array(text("S%d", F.col("page_id") % 5)), title=F.col("url"), source="sebi", seq=F.col("page_id")),
        rows(p.where("page_id % 2 = 1"), record_type="RegulatoryDocument", record_id=text("%d", "page_id"), regulatory_id=text("%d", F.col("page_id") - 1), source="sebi", seq=F.col("page_id")),
        rows(e, record_type=generic, record_id=text("%d", "event_id"), instrument_id=text("S%d", F.col("user_id") % 50), source=text("s%d", F.col("event_id") % 2), raw_ref=text("e%d", "event_id"), seq=F.col("event_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_TYPES = ", ".join(f"({k}, '{t}', {'NULL' if p is None else repr(p)})" for k, (t, p) in enumerate(_GENERIC))
_STATED = f"""g(k, record_type, predicate) AS (VALUES {_TYPES}),
ev AS (SELECT event_id, 'S' || user_id % 50 AS i, 's' || event_id % 2 AS source, record_type, predicate FROM events JOIN g ON k = event_id % {len(_GENERIC)}),
ord AS (SELECT o_orderkey AS k, 'S' || o_custkey % 50 AS i, o_orderstatus FROM orders),
st AS (
  SELECT 'company:S' || s_suppkey AS subject_id, 'has_instrument' AS predicate, 'instrument:S' || s_suppkey AS object_id, NULL AS valid_from, 'ref' AS source, ['r' || s_suppkey] AS evidence, NULL AS symbol FROM supplier
  UNION ALL SELECT 'index:N' || n_nationkey, 'contains_instrument', 'instrument:S' || s_suppkey, '2024-01-01', 'ref', [], n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'index:N' || n_nationkey, 'has_index_record', 'record:IndexSnapshot:x' || n_nationkey, NULL, 'nse', ['x' || n_nationkey], NULL FROM nation
  UNION ALL SELECT 'company:' || i, 'has_filing', 'filing:F' || k, NULL, 'nse', ['f' || k], NULL FROM ord
  UNION ALL SELECT 'filing:F' || k, 'has_document_asset', 'document_asset:A' || k, NULL, 'nse', ['f' || k], NULL FROM ord
  UNION ALL SELECT 'filing:F' || k, 'has_document_asset', 'document_asset:A' || k, NULL, 'bse', ['d' || k, 'f' || k, 'o' || k], NULL FROM ord
  UNION ALL SELECT 'company:' || i, 'has_document', 'document:D' || k, NULL, 'site', [], NULL FROM ord
  UNION ALL SELECT 'company:S' || i, 'has_news', 'news:n' || doc_id, NULL, source, [], NULL FROM (SELECT doc_id, source, unnest([doc_id % 7, doc_id % 11]) AS i FROM documents)
  UNION ALL SELECT 'company:S' || page_id % 5, 'has_regulatory_item', 'regulatory:' || page_id, NULL, 'sebi', [], NULL FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT 'regulatory:' || (page_id - 1), 'has_document', 'regulatory_document:' || page_id, NULL, 'sebi', [], NULL FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT 'company:' || i, predicate, 'record:' || record_type || ':' || event_id, NULL, source, ['e' || event_id], NULL FROM ev WHERE predicate IS NOT NULL)"""


@query("grf_01_record_edges", f"""WITH {_STATED} SELECT sha256(concat_ws('|', subject_id, predicate, object_id, valid_from)) AS relationship_id, subject_id, predicate, object_id, valid_from,
    CASE WHEN count(DISTINCT source) > 1 THEN 'multiple' ELSE min(source) END AS source, coalesce(len(list_distinct(flatten(list(evidence)))), 0) AS n_evidence, max(symbol) AS index_symbol,
    CASE WHEN count(DISTINCT source) > 1 THEN string_agg(DISTINCT source, ',' ORDER BY source) END AS sources FROM st GROUP BY ALL""")
def grf_01_record_edges(spark, d):
    found = relationships.edges_of(relationships.stated(mixed_records(spark, d), "seq"))
    return found.select("*", F.col("metadata")["index_symbol"].alias("index_symbol"), F.col("metadata")["sources"].alias("sources")).drop("metadata")


@query("grf_01_record_nodes", f"""WITH {_STATED}, no AS (
  SELECT 'company:S' || s_suppkey AS node_id, 'company' AS node_type, s_name AS label, 1 AS said, 'S' || s_suppkey AS instrument_id, NULL AS record_type, NULL AS document_type FROM supplier
  UNION ALL SELECT 'instrument:S' || s_suppkey, 'instrument', s_name, 1, 'S' || s_suppkey, NULL, NULL FROM supplier
  UNION ALL SELECT 'index:N' || n_nationkey, 'index', n_name, 1, NULL, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'index:N' || n_nationkey, 'index', 'N' || n_nationkey, 0, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'record:IndexSnapshot:x' || n_nationkey, 'record', 'x' || n_nationkey, 0, NULL, 'IndexSnapshot', NULL FROM nation
  UNION ALL SELECT 'filing:F' || k, 'filing', 'Results', 1, i, NULL, NULL FROM ord
  UNION ALL SELECT 'document_asset:A' || k, 'document_asset', 'Asset ' || k, 1, i, NULL, NULL FROM ord
  UNION ALL SELECT 'document:D' || k, 'document', 'D' || k, 0, i, NULL, o_orderstatus FROM ord
  UNION ALL SELECT 'news:n' || doc_id, 'news', 'n' || doc_id, 0, NULL, NULL, NULL FROM documents
  UNION ALL SELECT 'regulatory:' || page_id, 'regulatory', url, 1, NULL, NULL, NULL FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT 'regulatory:' || (page_id - 1), 'regulatory', (page_id - 1)::VARCHAR, 0, NULL, NULL, NULL FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT 'regulatory_document:' || page_id, 'regulatory_document', page_id::VARCHAR, 0, NULL, NULL, NULL FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT 'record:' || record_type || ':' || event_id, 'record', event_id::VARCHAR, 0, i, record_type, NULL FROM ev
  UNION ALL SELECT subject_id, 'company', substr(subject_id, 9), 0, substr(subject_id, 9), NULL, NULL FROM st WHERE subject_id LIKE 'company:%')
  SELECT node_id, node_type, max_by(label, said) AS label, min(instrument_id) AS instrument_id, max(record_type) AS record_type, max(document_type) AS document_type FROM no GROUP BY node_id, node_type""")
def grf_01_record_nodes(spark, d):
    found = relationships.nodes_of(relationships.stated(mixed_records(spark, d), "seq"))
    return found.select("*", F.col("metadata")["record_type"].alias("record_type"), F.col("metadata")["document_type"].alias("document_type")).drop("metadata")


@query("grf_01_evidence", f"WITH {_STATED} SELECT DISTINCT sha256(concat_ws('|', subject_id, predicate, object_id, valid_from)) AS relationship_id, unnest(evidence) AS evidence_id FROM st")
def grf_01_evidence(spark, d):
    return relationships.evidence_of(relationships.stated(mixed_records(spark, d), "seq"))


# ---- what was known at many instants ----

_ASKED = "q AS (SELECT TIMESTAMP '2024-01-01' + k * INTERVAL 17 HOUR AS as_of FROM range(50) AS t(k))"


def instants(spark):
    start = F.lit("2024-01-01").cast("timestamp")
    return spark.range(50).select((start + F.make_dt_interval(F.lit(0), (F.col("id") * 17).cast("int"))).alias("as_of"))


@query("tmp_09_state_at", f"""WITH {STAMPED}, {_ASKED} SELECT as_of, l.* FROM q, LATERAL (
    SELECT instrument_id, record_type, record_id, available_at FROM env WHERE basis <> 'retrieved' AND available_at <= q.as_of
    QUALIFY row_number() OVER (PARTITION BY instrument_id, record_type ORDER BY available_at DESC, record_id DESC) = 1) AS l""")
def tmp_09_state(spark, d):
    """The latest visible record of each instrument and type at each of fifty instants."""
    key = ("instrument_id", "record_type")
    found = temporal.versions(temporal.with_envelope(stamped(spark, d)), key)
    return temporal.known_at(found, instants(spark), key).select("as_of", *key, "record_id", "available_at")


@query("tmp_09_versions", f"""WITH {STAMPED}, v AS (SELECT instrument_id, record_type, record_id, available_at AS known_from,
    lead(available_at) OVER (PARTITION BY instrument_id, record_type ORDER BY available_at, record_id) AS known_to FROM env WHERE basis <> 'retrieved' AND available_at IS NOT NULL)
    SELECT * FROM v WHERE known_to IS NULL OR known_to > known_from""")
def tmp_09_versions(spark, d):
    found = temporal.versions(temporal.with_envelope(stamped(spark, d)), ("instrument_id", "record_type"))
    return found.select("instrument_id", "record_type", "record_id", "known_from", "known_to")


@query("tmp_09_state_asked", f"""WITH {STAMPED}, q AS (SELECT o_custkey AS instrument_id, TIMESTAMP '2024-01-01' + o_orderkey % 1000 * INTERVAL 1 HOUR AS as_of, o_orderkey FROM orders)
    SELECT o_orderkey, env.instrument_id, record_type, record_id FROM q JOIN env ON env.instrument_id = q.instrument_id AND available_at <= as_of AND basis <> 'retrieved'
    QUALIFY row_number() OVER (PARTITION BY o_orderkey, env.instrument_id, record_type ORDER BY available_at DESC, record_id DESC) = 1""")
def tmp_09_asked(spark, d):
    """The same at an instant of each order, for the instrument that it names."""
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 1000).cast("int"))
    asked = read(spark, d, "orders").select(F.col("o_custkey").alias("instrument_id"), at.alias("as_of"), "o_orderkey")
    key = ("instrument_id", "record_type")
    found = temporal.versions(temporal.with_envelope(stamped(spark, d)), key)
    return temporal.known_at(found, asked, key).select("o_orderkey", *key, "record_id")
