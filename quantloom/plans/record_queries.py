"""Queries of payload parsers, statement metrics, filings, record keys, price fields and lineage.

Payloads are made of the driver's tables and then read; each SQL says from the tables what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import canonical, fundamentals, prices, quality, records
from quantloom.plans import context
from quantloom.plans.catalog import query
from quantloom.sources import exchange, markup, parsers, xbrl
from quantloom.sources.driver_tables import read

# ---- statement metrics ----


@query("fnd_01_normal_key", "SELECT s_suppkey, 'supplier ' || s_suppkey || ' total assets net' AS key FROM supplier")
def fnd_01(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", fundamentals.normal_key(F.concat(F.lit("  Supplier#"), F.col("s_suppkey").cast("string"), F.lit(" -- Total_Assets (Net)"))).alias("key"))


@query(
    "fnd_02_flat_metrics",
    """SELECT o_orderkey, name, value FROM (
      SELECT o_orderkey, 'income statement revenue' AS name, o_totalprice AS value FROM orders UNION ALL
      SELECT o_orderkey, 'income statement lines tax', o_custkey + 0.5::DOUBLE FROM orders UNION ALL
      SELECT o_orderkey, 'balance total assets', o_orderkey::DOUBLE FROM orders UNION ALL
      SELECT o_orderkey, 'twice', 2.0::DOUBLE FROM orders)""",
    "value",
)
def fnd_02(spark, d):
    text = F.format_string(
        '{"Income Statement":{"Revenue":{"value":%s,"unit":"INR"},"Audited":true,"Lines":[{"Tax":"%d.5"},{"Note":"n/a"}]},"Balance":[{"Total-Assets":%d}],"Twice":1,"twice":2,"value":9}',
        F.col("o_totalprice").cast("decimal(20,4)").cast("string"), "o_custkey", "o_orderkey",
    )
    return fundamentals.flat_metrics(read(spark, d, "orders").select("o_orderkey", text.alias("t")), "t", "o_orderkey").drop("place")


_NAMED = (
    ("Net Sales", "a"), ("Total-Revenue", "b"), ("Minority Interest", "c"), ("Total Current Assets", "d"), ("TOTAL assets", "a"), ("Other PAT", "b"), ("Adjusted net income", "c"),
    ("Balance sheet: long term debt", "d"), ("Short debt", "a"), ("Profit before tax", "b"), ("Closing cash", "c"), ("Cash & cash equivalents of the group", "d"), ("Taxation", "a"), ("Deferred taxation", "b"),
)
_SUMS = "s AS (SELECT l_suppkey AS k, sum(l_extendedprice) AS a, sum(l_quantity) AS b, sum(l_tax) AS c, sum(l_discount) AS d FROM lineitem GROUP BY 1)"
#: By the rules: exact names before endings, earlier aliases before later ones, then the shortest name. Interest has no alias here.
_RESOLVED = (("revenue", "a"), ("current_assets", "d"), ("total_assets", "a"), ("net_income", "b"), ("total_debt", "a"), ("ebt", "b"), ("cash", "c"), ("tax_expense", "a"))


def sums(spark, d):
    total = lambda c, n: F.sum(c).alias(n)
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("instrument_id")).agg(total("l_extendedprice", "a"), total("l_quantity", "b"), total("l_tax", "c"), total("l_discount", "d"))


@query("fnd_03_resolve_metric", f"WITH {_SUMS} " + " UNION ALL ".join(f"SELECT k AS instrument_id, '{concept}' AS concept, {c} AS value FROM s" for concept, c in _RESOLVED), "value")
def fnd_03(spark, d):
    named = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(n).alias("name"), F.col(c).alias("value")) for k, (n, c) in enumerate(_NAMED)))
    return fundamentals.resolved_metrics(sums(spark, d).select("instrument_id", F.inline(named)), ("instrument_id",), "seq").drop("name")


def statement_records(spark, d):
    """Two statements a order: one of income, one of the balance with a second revenue, known a week later."""
    o = read(spark, d, "orders")
    label = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.col("o_totalprice").cast("decimal(20,4)").cast("string")
    part = lambda kind, n, metrics, days: F.struct(
        F.concat(F.lit(kind), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.format_string('{"period":"%s","period_type":"Quarterly","statement_name":"%s","metrics":{%s}}', label, F.lit(kind), metrics).alias("payload"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(days))).alias("available_at"),
    )
    income = part("income", 0, F.format_string('"Income":{"Net Sales":{"value":%s},"Minority Interest":5}', price), 10)
    sheet = part("sheet", 1, F.format_string('"Sales":1,"Total Assets":"%d"', "o_orderkey"), 17)
    return o.select(F.col("o_orderkey").alias("instrument_id"), F.inline(F.array(income, sheet)))


_POINT = "SELECT o_orderkey AS instrument_id, CASE WHEN o_orderkey % 2 = 0 THEN last_day(o_orderdate) ELSE o_orderdate::DATE END::DATE AS period_end, 'quarterly' AS period_type"


@query("fnd_04_financial_points", f"""{_POINT}, 'income' AS statement_name, 'revenue' AS concept, 'income net sales' AS name, o_totalprice AS value FROM orders
    UNION ALL {_POINT}, 'sheet', 'revenue', 'sales', 1.0::DOUBLE FROM orders UNION ALL {_POINT}, 'sheet', 'total_assets', 'total assets', o_orderkey::DOUBLE FROM orders""", "value")
def fnd_04(spark, d):
    return fundamentals.financial_points(statement_records(spark, d)).select("instrument_id", "period_end", "period_type", "statement_name", "concept", "name", "value")


@query("fnd_08_metric_availability", f"""{_POINT}, 'revenue' AS concept, o_totalprice AS value, 'income' || o_orderkey AS record_id, o_orderdate::TIMESTAMP + INTERVAL 10 DAY AS available_at, o_orderdate::TIMESTAMP + INTERVAL 17 DAY AS period_available_at FROM orders
    UNION ALL {_POINT}, 'total_assets', o_orderkey::DOUBLE, 'sheet' || o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 17 DAY, o_orderdate::TIMESTAMP + INTERVAL 17 DAY FROM orders""", "value")
def fnd_08(spark, d):
    return fundamentals.period_values(fundamentals.financial_points(statement_records(spark, d))).drop("statement_type")


# ---- filings ----


@query("prs_24_xbrl_facts", """SELECT o_orderkey AS filing_id, * FROM (SELECT o_orderkey, 'Revenue' AS concept, (o_totalprice::DECIMAL(20,4) * 1000)::DOUBLE AS value, 'INR' AS unit, o_orderdate::DATE AS period_start, (o_orderdate + INTERVAL 90 DAY)::DATE AS period_end, NULL::DATE AS instant, 'One' AS axis FROM orders
    UNION ALL SELECT o_orderkey, 'Revenue', o_custkey + 0.25::DOUBLE, NULL, NULL, NULL, o_orderdate::DATE, NULL FROM orders
    UNION ALL SELECT o_orderkey, 'Gone', NULL, NULL, o_orderdate::DATE, (o_orderdate + INTERVAL 90 DAY)::DATE, NULL, 'One' FROM orders
    UNION ALL SELECT o_orderkey, 'Name', NULL, NULL, NULL, NULL, o_orderdate::DATE, NULL FROM orders)""".replace("o_orderkey AS filing_id, * FROM", "o_orderkey AS filing_id, concept, value, unit, period_start, period_end, instant, axis FROM"), "value")
def prs_24(spark, d):
    xml = F.format_string(
        '<?xml version="1.0"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:f="urn:f"><context id="c"><entity><segment><d:explicitMember dimension="f:Axis">One</d:explicitMember></segment></entity>'
        '<period><startDate>%s</startDate><endDate>%s</endDate></period></context><context id="e"><period><instant>%s</instant></period></context><unit id="u"><measure>INR</measure></unit>'
        '<f:Revenue contextRef="c" unitRef="u" decimals="0" scale="3">%s</f:Revenue><f:Revenue contextRef="e">%d.25</f:Revenue><f:Gone contextRef="c" xsi:nil="true"/><f:Name contextRef="e">Words</f:Name></xbrl>',
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_number(F.col("o_totalprice").cast("decimal(20,4)"), 4), "o_custkey",
    )
    found = xbrl.facts(read(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), xml.alias("xml")))
    return found.select("filing_id", "concept", F.col("value").cast("double").alias("value"), "unit", "period_start", "period_end", "instant", F.col("dimensions")["Axis"].alias("axis"))


@query("prs_14_filings", """SELECT o_orderkey AS k, 'NSE:S' || o_custkey AS instrument_id, 'Example Ltd' AS company_name, 'Results' AS filing_type, 'Results' AS subcategory, 'Quarterly results' AS title, (o_orderdate - INTERVAL 90 DAY)::DATE AS period_start, o_orderdate::DATE AS period_end,
    'Consolidated' AS statement_type, o_orderkey % 2 = 0 AS audited, o_orderdate::TIMESTAMP + INTERVAL 970 MINUTE AS published_at, o_orderdate::TIMESTAMP + INTERVAL 971 MINUTE AS received_at, 'https://d/' || o_orderkey AS details_url,
    p AS position, CASE p WHEN 0 THEN 'https://x/' || o_orderkey || '.xml' WHEN 1 THEN 'https://d/' || o_orderkey ELSE 'http://y/z.pdf' END AS url, CASE p WHEN 0 THEN 'xbrl_xml' WHEN 1 THEN 'unknown' ELSE 'pdf' END AS document_type FROM orders CROSS JOIN (VALUES (0), (1), (2)) v(p)""")
def prs_14(spark, d):
    """Rows under a key some levels down, with the names that exchanges give the fields."""
    o = read(spark, d, "orders")
    on = F.date_format("o_orderdate", "dd-MMM-yyyy")
    text = F.format_string('{"note":[1],"inner":{"filings":[{"symbol":"s%d","sm_name":"Example Ltd","xbrlFile":"https://x/%d.xml","details":"https://d/%d","text":"see http://y/z.pdf, and http://y/page","fromDate":"%s","toDate":"%s","type":"Results","title":"Quarterly results","auditedUnaudited":"%s","consolidatedStandalone":"Consolidated","broadcast_date_time":"%s 16:10:00","exchangeReceivedTime":"%s 16:11"},7]}}',
        "o_custkey", "o_orderkey", "o_orderkey", F.date_format(F.date_sub("o_orderdate", 90), "dd-MMM-yyyy"), on, F.when(F.col("o_orderkey") % 2 == 0, "Audited").otherwise("Unaudited"), on, on)
    f = exchange.filings(o.select(F.col("o_orderkey").alias("k"), text.alias("t")), "results", "t", "k")
    fields = ("k", "instrument_id", "company_name", "filing_type", "subcategory", "title", "period_start", "period_end", "statement_type", "audited", "published_at", "received_at", "details_url")
    return exchange.filing_assets(f, *fields).drop("filing_id")


@query("prs_20_regulatory", """SELECT 'sebi:' || substr(sha256('sebi|orders|Order ' || page_id || '|2026-01-05|' || url), 1, 32) AS regulatory_id, 'sebi:' || substr(sha256(url || '/d.pdf'), 1, 32) AS document_id, 'Order ' || page_id AS title, url || '/d.pdf' AS url, 2 AS n_links FROM pages""")
def prs_20(spark, d):
    p = read(spark, d, "pages")
    doc = F.concat("url", F.lit("/d.pdf"))
    rows = p.select(F.format_string(" Order %d ", "page_id").alias("t"), F.lit("2026-01-05").alias("published_at"), F.col("url").alias("detail_url"), F.array("url", doc, "url").alias("links"), F.array(doc).alias("document_urls"))
    items = exchange.regulatory_items(rows.withColumn("title", F.trim("t")), "orders")
    return exchange.regulatory_documents(items).join(items.select("regulatory_id", F.size("links").alias("n_links")), "regulatory_id").select("regulatory_id", "document_id", "title", "url", "n_links")


# ---- payloads ----


@query("prs_05_last_prices", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'IN' || s_suppkey ELSE 'K' || s_suppkey END AS instrument_id, 'K' || s_suppkey AS instrument_key, s_acctbal AS last_price, s_nationkey::BIGINT AS volume FROM supplier""", "last_price")
def prs_05(spark, d):
    s = read(spark, d, "supplier")
    text = F.format_string('{"data":{"K%d":{"ltp":%s,"ltq":1,"cp":2,"volume":%d},"bad":3}}', "s_suppkey", F.col("s_acctbal").cast("decimal(20,4)").cast("string"), "s_nationkey")
    known = s.where("s_suppkey % 2 = 0").select(F.format_string("K%d", "s_suppkey").alias("instrument_key"), F.format_string("IN%d", "s_suppkey").alias("instrument_id"))
    return exchange.last_prices(s.select(text.alias("t")), "t", known).select("instrument_id", "instrument_key", "last_price", "volume")


@query("prs_08_balance_sheets", """SELECT o_orderkey, last_day(o_orderdate)::DATE AS period_end, 'yearly' AS period_type, 'crores' AS units_in, part, name, value, change FROM (
    SELECT o_orderkey, o_orderdate, 'summary' AS part, 'Total Assets' AS name, o_totalprice AS value, NULL::DOUBLE AS change FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 'summary', 'Cash', o_custkey::DOUBLE, NULL FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate, 'summary', 'Net profit', o_custkey + 0.5::DOUBLE, 1.5::DOUBLE FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 'full_statement', 'Part', o_orderkey::DOUBLE, NULL FROM orders)""", "value change")
def prs_08(spark, d):
    """A history of whole periods, a summary by category with changes, and a full statement whose groups have both names."""
    period = F.date_format("o_orderdate", "MMM yyyy")
    text = F.format_string(
        '{"data":{"units_in":"crores","history":[{"period":"%s","Total Assets":"%s","Cash":%d},{"Cash":1}],"cash_flow":[{"category":"Net profit","particular":"x","history":[{"period":"%s","value":"%d.5","change":"1.5%%"},{"value":1}]}],'
        '"full_statement":[{"category":"Cat","particular":"Part","history":[{"period":"%s","value":%d}]},{"history":[{"period":"%s","value":1}]}]}}',
        period, F.format_number(F.col("o_totalprice").cast("decimal(20,4)"), 4), "o_custkey", period, "o_custkey", period, "o_orderkey", period,
    )
    return parsers.statement_snapshots(read(spark, d, "orders").select("o_orderkey", text.alias("payload")), "payload", "o_orderkey").drop("statement_type")


@query("prs_11_payload_rows", "SELECT o_orderkey, 1 AS rank, 'S' || o_custkey AS symbol FROM orders UNION ALL SELECT o_orderkey, 2, NULL FROM orders")
def prs_11(spark, d):
    shape = F.element_at(F.array(*(F.lit(x) for x in ('[{"symbol":"S%d"},{"x":"y"},3]', '{"data":[{"symbol":"S%d"},{"x":"y"}]}', '{"data":{"a":1},"Records":[{"symbol":"S%d"},{"x":1}]}', '{"a":[1],"b":[{"symbol":"S%d"},{}]}'))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = exchange.payload_rows(read(spark, d, "orders").select("o_orderkey", F.replace(shape, F.lit("%d"), F.col("o_custkey").cast("string")).alias("t")), "t", "o_orderkey")
    return rows.select("o_orderkey", "rank", exchange.of("symbol").alias("symbol"))


@query("prs_12_shareholding", "SELECT o_orderkey, last_day(o_orderdate)::DATE AS period_end, 51.25::DOUBLE AS promoter, o_custkey % 40 + 0.5::DOUBLE AS public, NULL::DOUBLE AS employee_trusts, sha256('R' || o_orderkey) AS raw_ref FROM orders", "promoter public employee_trusts")
def prs_12(spark, d):
    text = F.format_string('[{"date":"%s","pr_and_prgrp":"51.25","public_val":"%d.5","employeeTrusts":"-","recordId":"R%d"}]', F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")), F.col("o_custkey") % 40, "o_orderkey")
    return exchange.shareholding(read(spark, d, "orders").select("o_orderkey", text.alias("t")), "t", "o_orderkey").drop("published_on")


@query("prs_13_exchange_rows", """SELECT 'S' || o_custkey AS instrument_id, 'annual_general_meeting_dividend' AS action_type, DATE '2026-01-05' AS announcement_date, o_orderdate::DATE AS ex_date, NULL::DATE AS record_date,
    substr(sha256('board|S' || o_custkey || '|2026-01-05|Meeting ' || o_orderkey || '|'), 1, 24) AS event_id, 'Meeting ' || o_orderkey AS subject FROM orders""")
def prs_13(spark, d):
    o = read(spark, d, "orders").select(F.format_string("S%d ", "o_custkey").alias("SYMBOL"), F.lit("Annual General Meeting/Dividend").alias("PURPOSE"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("EX-DATE"), F.lit("-").alias("RECORD DATE"), F.format_string("Meeting %d", "o_orderkey").alias("SUBJECT"))
    on = F.lit("2026-01-05").cast("date")
    # both readers of the same file, matched by row
    both = o.withColumn("row", F.monotonically_increasing_id())
    a = exchange.exchange_actions(o, on).drop("book_closure_start", "book_closure_end", "face_value", "company_name", "series")
    e = exchange.exchange_events(both.drop("PURPOSE"), "board", on)
    e = e.select("event_id", "subject", "instrument_id")
    keyed = both.select(F.trim("SYMBOL").alias("instrument_id"), F.col("SUBJECT").alias("subject"), parsers.day(F.col("EX-DATE")).alias("ex_date"))
    return a.distinct().join(keyed.join(e, ["instrument_id", "subject"]), ["instrument_id", "ex_date"]).select("instrument_id", "action_type", "announcement_date", "ex_date", "record_date", "event_id", "subject")


@query("prs_15_index_rows", """SELECT n_nationkey, 'IDX' || n_nationkey AS index_symbol, n_name AS index_name, n_nationkey + 0.5::DOUBLE AS value, n_regionkey::DOUBLE AS change_percent, 'M' AS sector_macro, n_name AS sector FROM nation""", "value change_percent")
def prs_15(spark, d):
    n = read(spark, d, "nation")
    text = F.format_string('{"data":[{"indexSymbol":"IDX%d","index":"%s","last":"%d.5","pChange":%d},{"last":1}],"metadata":{"macro":"M"},"industryInfo":{"sector":"%s"}}', "n_nationkey", "n_name", "n_nationkey", "n_regionkey", "n_name")
    p = n.select("n_nationkey", text.alias("t"))
    return exchange.index_snapshots(p, "t", "n_nationkey").join(exchange.sector_classification(p, "t", "n_nationkey"), "n_nationkey").select("n_nationkey", "index_symbol", "index_name", "value", "change_percent", "sector_macro", "sector")


@query("prs_03_first_of_symbol", "SELECT 'S' || o_custkey AS symbol, min(o_orderkey) AS place, arg_min(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1", "close")
def prs_03(spark, d):
    o = read(spark, d, "orders")
    return exchange.first_of_symbol(o.select(F.format_string("s%d", "o_custkey").alias("symbol"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("close")), "place")


@query("prs_02_daily_universe", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'IN' || o_custkey ELSE 'NSE:S' || o_custkey END AS instrument_id, o_orderdate::TIMESTAMP - INTERVAL 330 MINUTE AS ts, o_totalprice AS close, o_orderkey::DOUBLE AS volume FROM orders""", "close volume")
def prs_02(spark, d):
    o = read(spark, d, "orders")
    isin = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("IN%d", "o_custkey")).otherwise("-")
    rows = o.select(isin.alias("ISIN CODE"), F.format_string("S%d", "o_custkey").alias("SYMBOL"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("TRADE_DATE"), F.format_number(F.col("o_totalprice").cast("decimal(20,4)"), 4).alias("CLOSE_PRICE"), F.col("o_orderkey").cast("string").alias("TTL_TRD_QNTY"))
    return parsers.daily_universe(rows).select("instrument_id", "ts", "close", "volume")


@query("prs_07_corporate_actions", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'dividend' WHEN 1 THEN 'bonus_issue' ELSE 'unknown' END AS action_type, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderdate - INTERVAL 30 DAY)::DATE END AS announcement_date,
    o_orderdate::DATE AS ex_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS record_date, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 0.5::DOUBLE END AS amount, CASE WHEN o_orderkey % 3 = 1 THEN '1:' || o_custkey END AS ratio FROM orders""", "amount")
def prs_07(spark, d):
    """Dividends, bonus issues under the other names of details, and entries with an expiry date alone."""
    day = lambda c: F.date_format(c, "dd MMM yyyy")
    before = day(F.date_sub("o_orderdate", 30))
    one = F.format_string('{"name":"Dividend","expiry_date":"1 Jan 2020","amount":%d.5,"ratio":null,"event_details":[{"name":"Announcement date","value":"%s"},7,{"name":"Ex dividend date","value":"%s"},{"name":"Record date","value":"%s"},{"value":"x"}]}', "o_custkey", before, day("o_orderdate"), day("o_orderdate"))
    two = F.format_string('{"name":"Bonus Issue","amount":"n/a","ratio":"1:%d","event_details":[{"name":"Announcement date","value":"%s"},{"name":"Ex Date","value":"%s"}]}', "o_custkey", before, day("o_orderdate"))
    three = F.format_string('{"expiry_date":"%s","event_details":null}', day("o_orderdate"))
    which = F.col("o_orderkey") % 3
    entry = F.when(which == 0, one).when(which == 1, two).otherwise(three)
    rows = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit('{"status":"success","data":["x",'), entry, F.lit("]}")).alias("t"))
    return parsers.corporate_actions(rows, "t", "o_orderkey")


@query("prs_10_macro", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'cpi' WHEN 1 THEN 'wpi' ELSE 'mospi' END AS series_id,
    CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('month', o_orderdate)::DATE ELSE date_trunc('year', o_orderdate)::DATE END AS observation_date,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'provisional' ELSE o_totalprice::DECIMAL(20,4)::VARCHAR END AS value_text, '%' AS unit FROM orders WHERE o_orderkey % 5 <> 0""", "value")
def prs_10(spark, d):
    """Months and years, series of a row's own and of the dataset, values that are no numbers, and none."""
    o = read(spark, d, "orders")
    plain = F.col("o_totalprice").cast("decimal(20,4)").cast("string")
    value = F.when(F.col("o_orderkey") % 5 == 0, "-").when(F.col("o_orderkey") % 7 == 0, "provisional").otherwise(plain)
    series = F.when(F.col("o_orderkey") % 3 == 0, "cpi").when(F.col("o_orderkey") % 3 == 1, "wpi")
    on = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return parsers.macro_observations(o.select(on.alias("Period"), value.alias("Inflation"), series.alias("Series Code"), F.lit("%").alias("Unit")), "mospi")


@query("prs_16_feed_items", """SELECT page_id, 'Page ' || page_id || ' & more' AS title, 'http://h/' || page_id AS url, 'text' AS summary, TIMESTAMP '2026-01-05 04:30:00' AS published_at, 'news:' || substr(sha256('http://h/' || page_id || '|Page ' || page_id || ' & more'), 1, 32) AS news_id FROM pages""")
def prs_16(spark, d):
    rss = F.format_string('<rss><channel><title>x</title><item><title>Page %d &amp;amp; more</title><link>http://h/%d</link><description>&lt;b&gt;text&lt;/b&gt;</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0530</pubDate></item></channel></rss>', "page_id", "page_id")
    return parsers.from_feed(read(spark, d, "pages").select("page_id", rss.alias("t")), "t", "page_id").select("page_id", "title", "url", "summary", "published_at", "news_id")


@query("prs_19_listing_rows", "SELECT page_id, 'Order ' || page_id AS title, 'http://h/d/' || page_id || '.html' AS detail_url, 'Jan 05, 2026' AS date_text, 2 AS n_links FROM pages")
def prs_19(spark, d):
    html = F.format_string('<table><tr><td>Jan 05, 2026</td><td><a href="/d/%d.html">Order %d</a> <a href="f.pdf">PDF</a></td></tr><tr><td><a href="?p=2">2</a></td></tr></table>', "page_id", "page_id")
    pages = read(spark, d, "pages").select(F.format_string("http://h/l/%d", "page_id").alias("url"), html.alias("html"))
    found = markup.listing_rows(pages)
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("page_id"), "title", "detail_url", "date_text", F.size("links").alias("n_links"))


@query("prs_25_constituents", """SELECT n_nationkey, 'NIFTY ' || n_nationkey AS index_symbol, 'NIFTY ' || n_nationkey AS index_name, 1 AS rank, 'I' || n_nationkey AS instrument_id, upper(n_name) AS symbol, 'Reliance' AS company_name, 9.12::DOUBLE AS weight_percent,
    n_regionkey + 0.5::DOUBLE AS price, 5.1::DOUBLE AS change, 0.34::DOUBLE AS change_percent, 1500100000.0::DOUBLE AS traded_value, 1000000::BIGINT AS volume FROM nation
    UNION ALL SELECT n_nationkey, 'NIFTY ' || n_nationkey, 'NIFTY ' || n_nationkey, 3, NULL, 'TCS', 'Tata', 6.21::DOUBLE, NULL, -10.1::DOUBLE, -0.31::DOUBLE, NULL, 500000::BIGINT FROM nation""", "weight_percent price change change_percent traded_value")
def prs_25(spark, d):
    text = F.format_string(
        '{"metadata":{"indexName":"NIFTY %d","indexSymbol":"NIFTY %d"},"data":[{"symbol":"%s","identifier":"Reliance","lastPrice":"%d.50","change":"5.10","pChange":"0.34","weight":"9.12","totalTradedVolume":"1,000,000","totalTradedValue":"1500100000"},'
        '{"lastPrice":1},{"symbol":"tcs","identifier":"Tata","lastPrice":"-","change":"-10.10","pChange":"-0.31","weightage":"6.21","totalTradedVolume":"500000"}]}', "n_nationkey", "n_nationkey", F.lower("n_name"), "n_regionkey",
    )
    n = read(spark, d, "nation")
    known = n.select(F.col("n_name").alias("symbol"), F.format_string("I%d", "n_nationkey").alias("instrument_id"))
    found = exchange.index_constituents(n.select("n_nationkey", text.alias("t")), "t", "n_nationkey", known=known)
    return found.select("n_nationkey", "index_symbol", "index_name", "rank", "instrument_id", "symbol", "company_name", "weight_percent", "price", "change", "change_percent", "traded_value", "volume")


@query("prs_12_insiders", """SELECT o_orderkey, 'NSE:S' || o_custkey AS instrument_id, 'Reliance Industries Limited' AS company_name, 'Regulation 7 (2)' AS regulation, 'Person ' || o_custkey AS person_name, 'Promoter' AS person_category,
    o_custkey::DOUBLE AS securities_prior, 50.0::DOUBLE AS holding_percent_prior, 1100.0::DOUBLE AS securities_acquired, o_totalprice AS transaction_value, 'Market Purchase' AS transaction_type, 55.0::DOUBLE AS holding_percent_post,
    o_orderdate::DATE AS acquisition_from, o_orderdate::DATE AS acquisition_to, o_orderdate::TIMESTAMP + INTERVAL 970 MINUTE AS intimation_date, 'Market Purchase' AS mode, 'https://example/x.xml' AS xbrl_url FROM orders""",
    "securities_prior holding_percent_prior securities_acquired transaction_value holding_percent_post")
def prs_12_insiders(spark, d):
    """The short names of the fields and the long ones of the same table."""
    day, at = F.date_format("o_orderdate", "dd-MMM-yyyy"), F.lit("16:10:00")
    args = ("o_custkey", "o_custkey", "o_custkey", F.format_number(F.col("o_totalprice").cast("decimal(20,4)"), 4), day, day, day, at)
    short = '{"symbol":"s%d","company":"Reliance Industries Limited","anex":"Regulation 7 (2)","acqName":"Person %d","personCategory":"Promoter","befAcqSharesNo":"%d","befAcqSharesPer":"50.0","secAcq":"1,100","secVal":"%s","tdpTransactionType":"Market Purchase","afterAcqSharesPer":"55.0","acqfromDt":"%s","acqtoDt":"%s","intimDt":"%s %s","acqMode":"Market Purchase","xbrl":"https://example/x.xml"}'
    long = '{"SYMBOL":"s%d","COMPANY":"Reliance Industries Limited","REGULATION":"Regulation 7 (2)","NAME OF THE ACQUIRER/DISPOSER":"Person %d","CATEGORY OF PERSON":"Promoter","NO. OF SECURITY (PRIOR)":"%d","% SHAREHOLDING (PRIOR)":"50.0","NO. OF SECURITIES (ACQUIRED/DISPCLOSED)":"1,100","VALUE OF SECURITY (ACQUIRED/DISPCLOSED)":"%s","ACQUISITION/DISPOSAL TRANSACTION TYPE":"Market Purchase","% POST":"55.0","DATE OF ALLOTMENT/ACQUISITION FROM":"%s","DATE OF ALLOTMENT/ACQUISITION TO":"%s","DATE OF INITMATION TO COMPANY":"%s %s","MODE OF ACQUISITION":"Market Purchase","XBRL":"https://example/x.xml"}'
    long = long.replace("% S", "%% S").replace("% P", "%% P")
    row = F.when(F.col("o_orderkey") % 2 == 0, F.format_string(short, *args)).otherwise(F.format_string(long, *args))
    found = exchange.insider_transactions(read(spark, d, "orders").select("o_orderkey", F.concat(F.lit('{"data":['), row, F.lit("]}")).alias("t")), "t", "o_orderkey")
    return found.select(
        "o_orderkey", "instrument_id", "company_name", "regulation", "person_name", "person_category", "securities_prior", "holding_percent_prior", "securities_acquired", "transaction_value", "transaction_type",
        "holding_percent_post", "acquisition_from", "acquisition_to", "intimation_date", "mode", "xbrl_url",
    )


@query("prs_12_large_deals", """SELECT l_orderkey, l_linenumber, 'SYM' || l_suppkey AS symbol, 'Reliance' AS company_name, 'bulk_deals' AS deal_type, l_shipdate::DATE AS trade_date, 'Example Fund' AS client_name, CASE WHEN l_linenumber % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    l_quantity AS quantity, l_extendedprice AS weighted_average_price FROM lineitem""", "quantity weighted_average_price")
def prs_12_deals(spark, d):
    side = F.when(F.col("l_linenumber") % 2 == 0, "BUY").otherwise("SELL")
    plain = lambda c: F.col(c).cast("decimal(20,4)").cast("string")
    text = F.format_string('{"as_on_date":"02-10-2026","BLOCK_DEALS_DATA":[{"symbol":"no"}],"BULK_DEALS_DATA":[{"date":"%s","symbol":"sym%d","name":"Reliance","clientName":"Example Fund","buySell":"%s","qty":%s,"watp":"%s"}]}',
        F.date_format("l_shipdate", "dd-MMM-yyyy"), "l_suppkey", side, plain("l_quantity"), plain("l_extendedprice"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return exchange.large_deals(rows, "bulk_deals", "t", "l_orderkey", "l_linenumber").drop("event_id", "remarks")


@query("prs_01_columns", "SELECT s_suppkey, s_name AS name, s_acctbal AS value FROM supplier", "value")
def prs_01(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("Company NAME"), F.col("s_acctbal").alias("Acct_Bal"))
    return s.select("s_suppkey", parsers.column_named(s, "companyName", "name").alias("name"), parsers.column_named(s, "balance", "acct bal").alias("value"))


# ---- keys of record types ----

#: Record type -> SQL of its key's parts over events; every type keeps what its table says, by event id.
_TYPES = {
    "ded_03_instruments": ("instruments", {"instrument_id": "user_id % 50"}),
    "ded_04_actions": ("corporate_actions", {"instrument_id": "user_id", "action_type": "event_type", "announcement_date": "cast(ts AS date)", "ex_date": "cast(NULL AS date)", "record_date": "cast(NULL AS date)", "ratio": "cast(NULL AS double)", "amount": "cast(NULL AS double)"}),
    "ded_05_events": ("company_events", {"event_id": "event_id % 500"}),
    "ded_06_shareholding": ("shareholding", {"instrument_id": "user_id", "period_end": "cast(ts AS date)"}),
    "ded_07_insiders": ("insider_transactions", {"event_id": "event_id % 300"}),
    "ded_08_deals": ("large_deals", {"event_id": "event_id % 200"}),
    "ded_09_index_snapshots": ("index_snapshots", {"index_symbol": "event_type", "timestamp": "cast(ts AS date)"}),
    "ded_10_constituents": ("index_constituents", {"index_symbol": "event_type", "symbol": "user_id"}),
    "ded_12_regulatory": ("regulatory_items", {"regulatory_id": "event_id % 700"}),
}


def _deduplicated(kind, parts):
    def run(spark, d):
        rows = read(spark, d, "events").selectExpr(*(f"{sql} AS {c}" for c, sql in parts.items()), "value", "event_id AS seq")
        keys, which = records.KEYS[kind]
        return records.one_of_each(rows, keys, F.col("seq"), which)

    return run


for _name, (_kind, _parts) in _TYPES.items():
    _which = "min" if records.KEYS[_kind][1] == "first" else "max"
    _keys = ", ".join(f"{sql} AS {c}" for c, sql in _parts.items())
    query(_name, f"SELECT {', '.join(_parts)}, arg_{_which}(value, seq) AS value, {_which}(seq) AS seq FROM (SELECT {_keys}, value, event_id AS seq FROM events) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY " + ", ".join(_parts)), "value")(_deduplicated(_kind, _parts))


@query("can_06_observations_of_records", """SELECT sha256('events|company_events|typed:company_events|{"event_id":"' || event_id::VARCHAR || '"}') AS canonical_record_id, user_id::VARCHAR AS entity_key, 'value' AS field, value FROM events WHERE value IS NOT NULL""", "value")
def can_06(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("instrument_id"), "value", F.lit("s").alias("source"))
    return canonical.observations_of_records(e, "company_events", ("value",), "events").select("canonical_record_id", "entity_key", "field", "value")


# ---- price fields and lineage ----


@query("prm_04_price_records", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts::DATE::TIMESTAMP ELSE ts END AS ts, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 7.5 WHEN 2 THEN event_id ELSE 3 END::DOUBLE AS close,
    user_id::DOUBLE AS volume, CASE WHEN event_id % 4 = 1 THEN 9.0 END::DOUBLE AS traded_value FROM events WHERE event_id % 4 <> 0 OR value IS NOT NULL""", "close volume traded_value")
def prm_04(spark, d):
    e = read(spark, d, "events")
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    shape = (
        F.when(k % 4 == 0, F.concat(F.lit('{"close":'), F.coalesce(F.format_string("%.17g", "value"), F.lit("null")), F.lit(',"volume":'), user, F.lit("}")))
        .when(k % 4 == 1, F.concat(F.lit('{"close":"n/a","Close":" 7.5 ","turnover":9,"total_traded_quantity":"'), user, F.lit('"}')))
        .when(k % 4 == 2, F.concat(F.lit('{"close":true,"last_price":'), k.cast("string"), F.lit(',"Volume":'), user, F.lit("}")))
        .otherwise(F.concat(F.lit('{"close":"","ltp":3,"volume":"NaN","Volume":'), user, F.lit("}")))
    )
    dated = F.when(k % 2 == 0, F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"trade_date":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}'))).otherwise(F.col("j"))
    rows = e.withColumn("j", shape).select("event_id", F.col("ts").cast("timestamp").alias("event_time"), dated.alias("payload"))
    return prices.price_records(rows, "payload", "event_id").select("event_id", "ts", "close", "volume", "traded_value")


@query("prm_02_lineage", """WITH u AS (SELECT user_id AS result_id, event_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events),
    l AS (SELECT event_id AS record_id, event_id // 2 AS observation_id FROM events)
    SELECT result_id, 'record' AS kind, record_id::VARCHAR AS id, position::INT AS position FROM u
    UNION ALL SELECT result_id, 'observation', observation_id::VARCHAR, min(position)::INT FROM u JOIN l ON l.record_id = u.record_id GROUP BY 1, 3
    UNION ALL SELECT result_id, 'raw', 'raw' || observation_id % 9, min(position)::INT FROM u JOIN l ON l.record_id = u.record_id WHERE observation_id % 3 > 0 GROUP BY 1, 3""")
def prm_02(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events")
    used = e.select(F.col("user_id").alias("result_id"), F.col("event_id").alias("record_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("position"))
    links = e.select(F.col("event_id").alias("record_id"), F.expr("event_id div 2").alias("observation_id"), F.lit(0).alias("place"))
    k = F.col("observation_id")
    observed = links.select("observation_id").distinct().withColumn("raw_ref", F.when(k % 3 > 0, F.concat(F.lit("raw"), (k % 9).cast("string"))))
    return prices.lineage(used, links, observed).drop("place")


# ---- representation ----


@query("rpr_01_prepared", """SELECT s_suppkey, s_name, s_acctbal AS "holders.promoter", CASE WHEN s_nationkey > 10 THEN s_nationkey END AS "holders.public" FROM supplier""", '"holders.promoter"')
def rpr_01(spark, d):
    s = read(spark, d, "supplier")
    holders = F.struct(F.col("s_acctbal").alias("promoter"), F.when(F.col("s_nationkey") > 10, F.col("s_nationkey")).alias("public"), F.lit(None).cast("double").alias("none"))
    rows = s.select("s_suppkey", "s_name", holders.alias("holders"), F.lit(None).cast("string").alias("nothing"), F.lit("x").alias("same"), F.lit("h").alias("content_hash"), F.col("s_suppkey").alias("record_id"), F.struct(F.lit("nse").alias("source")).alias("provenance"))
    return context.prepared(rows, expand=("holders",))[0]


@query("rpr_01_policy_lines", """SELECT '| ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || 'Client ' || o_custkey || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END || ' | ' || o_orderkey || ' | ' || o_custkey || '.5 | s' || o_orderkey % 3 || ' |' AS line FROM orders
    UNION ALL SELECT '| ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN 'quarterly' ELSE 'yearly' END || ' | ' || o_custkey || ' | ' || o_orderkey || ' |' FROM orders""")
def rpr_01_policies(spark, d):
    """Large deals and statements, whose columns come in any order, as the lines that their policies make."""
    o = read(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    deals = o.select(
        F.format_string("s%d", F.col("o_orderkey") % 3).alias("extra"), F.format_string("%d.5", "o_custkey").alias("weighted_average_price"), F.col("o_orderkey").cast("string").alias("quantity"), day.alias("trade_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("o_orderkey").alias("event_id"), F.format_string("Client %d", "o_custkey").alias("client_name"), F.lit("bulk").alias("deal_type"),
        F.lit(None).cast("string").alias("remarks"), F.col("o_custkey").alias("instrument_id"),
    )
    metrics = F.struct(F.col("o_custkey").alias("revenue"), F.col("o_orderkey").alias("cash"))
    statements = o.select(metrics.alias("metrics"), F.when(F.col("o_orderkey") % 2 == 0, "quarterly").otherwise("yearly").alias("period_type"), F.col("o_custkey").alias("instrument_id"), day.alias("period_end"))
    both = [context.lines(context.by_policy(df, kind)[0])[1] for df, kind in ((deals, "LargeDeal"), (statements, "FundamentalSnapshot"))]
    return both[0].unionByName(both[1])


@query("rpr_04_json_lines", """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"' || CASE WHEN s_nationkey > 10 THEN ',"n":' || s_nationkey ELSE '' END || '}' AS line FROM supplier""")
def rpr_04(spark, d):
    s = read(spark, d, "supplier")
    return context.json_lines(s.select("s_suppkey", "s_name", F.lit("INR").alias("unit"), F.when(F.col("s_nationkey") > 10, F.col("s_nationkey")).alias("n")))[1]


_RECORDS = [context.Section("first", kinds=(), records=("error", "signup"), max_records=3), context.Section("second", kinds=(), records=("signup", "view"), max_records=4, newest=False)]


@query("ctx_01_records", """WITH r AS (SELECT user_id, event_id, ts, 1 AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('error', 'signup')
    UNION ALL SELECT user_id, event_id, ts, 2, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) FROM events WHERE event_type IN ('signup', 'view')),
    o AS (SELECT user_id, event_id, min(ts) AS ts, min(place) AS place FROM r WHERE k <= CASE place WHEN 1 THEN 3 ELSE 4 END GROUP BY 1, 2)
    SELECT user_id AS instrument_id, CASE place WHEN 1 THEN 'first' ELSE 'second' END AS section, event_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY place, ts, event_id) AS position FROM o""")
def ctx_01_records(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("instrument_id"), F.col("event_id").alias("record_id"), F.col("event_type").alias("record_type"), F.col("ts").alias("at"))
    return context.select_records(e, _RECORDS)


@query("ctx_02_compact", """WITH i AS (SELECT user_id, event_id % 60 AS m, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT user_id, 'i' || m AS item_id, CASE m % 3 WHEN 0 THEN 'summary' ELSE 'series' END AS kind, CASE WHEN m % 3 = 0 THEN 1 WHEN m % 3 = 1 THEN 2 ELSE 3 END AS place, n * 20 AS points FROM i WHERE m < 30),
    w AS (SELECT *, CASE kind WHEN 'series' THEN least(points, CASE place WHEN 2 THEN 30 ELSE 52 END) ELSE 0 END AS wanted FROM c),
    u AS (SELECT *, coalesce(sum(wanted) OVER (PARTITION BY user_id ORDER BY place, kind <> 'summary', item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place, kind <> 'summary', item_id) AS position FROM u WHERE kind <> 'series' OR used < 500)
    SELECT user_id AS instrument_id, item_id, CASE place WHEN 1 THEN 'summaries' WHEN 2 THEN 'recent_market' ELSE 'weekly_context' END AS section, position,
    CASE WHEN kind = 'series' THEN least(wanted, 500 - used)::BIGINT END AS included_points FROM s WHERE position <= 24""")
def ctx_02(spark, d):
    m = F.col("event_id") % 60
    kind = F.when(m % 3 == 0, "summary").otherwise("series")
    metric = F.when(m >= 30, "unknown").when(m % 3 == 0, "persistence").when(m % 3 == 1, "sma_20").otherwise("week_return")
    e = read(spark, d, "events")
    items = e.groupBy(F.col("user_id").alias("instrument_id"), F.concat(F.lit("i"), m.cast("string")).alias("item_id"), kind.alias("kind"), metric.alias("metric")).agg((F.count(F.lit(1)) * 20).alias("points"))
    none = e.limit(0).select(F.col("user_id").alias("instrument_id"), F.col("event_id").alias("record_id"), F.col("event_type").alias("record_type"), F.col("ts").alias("at"))
    return context.compact(items, none)[0].select("instrument_id", "item_id", "section", "position", "included_points")


#: Of each profile: metrics of its series sections with their caps (place, metric, points), items, points.
_PROFILE_ITEMS = {"compact": (((2, "sma_20", 30), (3, "week_return", 52)), 24, 500), "medium": (((2, "sma_20", 90), (3, "week_return", 156)), 40, 1600), "full": (((2, "sma_20", 252),), 100, 8000), "wide": (((2, "sma_20", 252),), 180, 4000)}
_PROFILE_NAMES = {"compact": ("summaries", "recent_market", "weekly_context"), "medium": ("summaries", "recent_market", "weekly_context"), "full": ("summaries", "market_series"), "wide": ("derived_research", "derived_market_series")}


def _profile_sql(name: str) -> str:
    caps, items, points = _PROFILE_ITEMS[name]
    place = "CASE metric WHEN 'persistence' THEN 1 " + " ".join(f"WHEN '{m}' THEN {p}" for p, m, _ in caps) + (" WHEN 'unknown' THEN CASE kind WHEN 'summary' THEN 1 END" if name in ("full", "wide") else "") + " END"
    cap = "CASE place " + " ".join(f"WHEN {p} THEN {c}" for p, _, c in caps) + " END"
    section = "CASE place " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_PROFILE_NAMES[name], 1)) + " END"
    order = "PARTITION BY user_id ORDER BY place, kind <> 'summary', item_id"
    return f"""SELECT '{name}' AS profile, user_id AS instrument_id, item_id, {section} AS section, position, CASE WHEN kind = 'series' THEN least(wanted, {points} - used)::BIGINT END AS included_points FROM (
      SELECT *, row_number() OVER ({order}) AS position FROM (
        SELECT *, coalesce(sum(wanted) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
          SELECT *, CASE kind WHEN 'series' THEN least(points, {cap}) ELSE 0 END AS wanted FROM (SELECT *, {place} AS place FROM c) WHERE place IS NOT NULL)) WHERE kind <> 'series' OR used < {points}) WHERE position <= {items}"""


@query("ctx_02_profiles", """WITH i AS (SELECT user_id, event_id % 60 AS m, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT user_id, 'i' || m AS item_id, CASE m % 3 WHEN 0 THEN 'summary' ELSE 'series' END AS kind, CASE WHEN m >= 30 THEN 'unknown' WHEN m % 3 = 0 THEN 'persistence' WHEN m % 3 = 1 THEN 'sma_20' ELSE 'week_return' END AS metric, n * 20 AS points FROM i) """
    + " UNION ALL ".join(f"SELECT * FROM ({_profile_sql(name)})" for name in _PROFILE_ITEMS))
def ctx_02_profiles(spark, d):
    """The items that each of the four profiles selects."""
    m = F.col("event_id") % 60
    kind = F.when(m % 3 == 0, "summary").otherwise("series")
    metric = F.when(m >= 30, "unknown").when(m % 3 == 0, "persistence").when(m % 3 == 1, "sma_20").otherwise("week_return")
    e = read(spark, d, "events")
    items = e.groupBy(F.col("user_id").alias("instrument_id"), F.concat(F.lit("i"), m.cast("string")).alias("item_id"), kind.alias("kind"), metric.alias("metric")).agg((F.count(F.lit(1)) * 20).alias("points"))
    none = spark.createDataFrame([], "instrument_id long, record_id long, record_type string, at timestamp")
    parts = [context.profile(name, items, none)[0].select(F.lit(name).alias("profile"), "instrument_id", "item_id", "section", "position", "included_points") for name in context.PROFILES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_RECORD_SECTIONS = {
    "compact": (("identity_facts", 2, (0, 1)), ("recent_market_facts", 30, (2,)), ("event_facts", 20, (3, 4))), "medium": (("identity_facts", 2, (0, 1)), ("recent_market_facts", 90, (2,)), ("event_facts", 40, (3, 4))),
    "full": (("identity_facts", 2, (0, 1)), ("market_facts", 252, (2,)), ("event_facts", 100, (3, 4))),
    "wide": (("identity", 4, (0, 1)), ("market_and_indices", 252, (2, 5)), ("fundamentals", 48, (4,)), ("news_and_social", 80, (3, 6))),
}
_RECORD_TYPES = ("Instrument", "SectorClassification", "PriceBar", "NewsItem", "Filing", "IndexPriceBar", "SocialPost", "Unheard")


@query("ctx_02_profile_records", " UNION ALL ".join(
    f"""SELECT '{name}' AS profile, o_custkey % 9 AS instrument_id, '{section}' AS section, o_orderkey AS record_id FROM orders WHERE o_orderkey % 8 IN ({', '.join(map(str, kinds))})
    QUALIFY row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY o_orderdate DESC, o_orderkey DESC) <= {most}""" for name, sections in _RECORD_SECTIONS.items() for section, most, kinds in sections))
def ctx_02_profile_records(spark, d):
    """The records that each of the four profiles selects."""
    kind = F.element_at(F.array(*map(F.lit, _RECORD_TYPES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    records = read(spark, d, "orders").select((F.col("o_custkey") % 9).alias("instrument_id"), F.col("o_orderkey").alias("record_id"), kind.alias("record_type"), F.col("o_orderdate").cast("timestamp").alias("at"))
    none = spark.createDataFrame([], "instrument_id long, item_id string, kind string, metric string, points long")
    parts = [context.profile(name, none, records)[1].select(F.lit(name).alias("profile"), "instrument_id", "section", "record_id") for name in context.PROFILES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("prs_18_news_items", """SELECT page_id, 'yfinance:' || substr(sha256(CASE WHEN page_id % 2 = 0 THEN 'n' || page_id ELSE 'http://h/' || page_id END), 1, 32) AS news_id, 'Page ' || page_id AS title,
    TIMESTAMP '2026-01-05 04:30:00' AS published_at, 'http://h/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'text' END AS summary, CASE WHEN page_id % 2 = 0 THEN 'Wire' ELSE 'Yahoo Finance' END AS source_name FROM pages""")
def prs_18(spark, d):
    inner = F.format_string('[{"id":"n%d","content":{"title":"Page %d","summary":"text","pubDate":"2026-01-05T04:30:00Z","canonicalUrl":{"url":"http://h/%d"},"provider":{"displayName":"Wire"}}},"x"]', "page_id", "page_id", "page_id")
    flat = F.format_string('[{"title":"Page %d","link":"http://h/%d","providerPublishTime":1767587400}]', "page_id", "page_id")
    text = F.when(F.col("page_id") % 2 == 0, inner).otherwise(flat)
    return parsers.news_items(read(spark, d, "pages").select("page_id", text.alias("t")), "t", "page_id")


@query("dq_07_nested_signature", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a.b.c:number,a.d:array,a.d[].e:string,f:null' WHEN 1 THEN 'a:object,x:array,x[]:array,x[][]:bool' ELSE '' END AS signature FROM orders""")
def dq_07_nested(spark, d):
    shape = F.element_at(F.array(*map(F.lit, ('{"a":{"b":{"c":1.5},"d":[{"e":"1"},{"z":2}]},"f":null}', '{"x":[[true,1]],"a":{}}', "not json"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", quality.json_signature(shape).alias("signature"))
