"""Exchange and regulator payloads: row lists wherever they are, last prices, shareholding, actions, events, filings,
index snapshots and sectors, regulatory items. A row is a map of text, so that a payload's spelling of a field doesn't matter.

Fixed values: the field names that the functions below ask for are those of the payloads, the preferred one first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import content_id
from quantloom.operators import nested
from quantloom.sources import dates
from quantloom.sources.parsers import column_named, day, document_type, number, period_end, short_id, text_or_null

ROW = "map<string,string>"
#: Keys under which payloads keep their rows; endings of documents; words for yes and no.
ROW_KEYS = ("data", "rows", "result", "results", "records", "items")
FILING_KEYS = ("data", "results", "records", "Table", "table", "rows", "filings")
DOCUMENT_FIELDS = "xbrl|attach|detail|file|document"
DOCUMENT_ENDINGS = r"(?i)\.(?:pdf|xml|xlsx|zip)"
YES, NO = ("audited", "yes", "true", "y", "1"), ("unaudited", "no", "false", "n", "0")


def payload_rows(payloads: DataFrame, text: str, *keep: str, keys: tuple[str, ...] = ROW_KEYS) -> DataFrame:
    """(…, rank, row): the rows of a JSON payload: the list that it is, else the one under the first of ``keys`` that is a list,
    else the first member that is a list of objects. What isn't an object in it is left out; ranks count what is left."""
    objects = lambda c: F.filter(F.from_json(c, "array<string>"), lambda x: F.coalesce(F.trim(x).startswith("{"), F.lit(False)))
    trimmed = F.trim(F.col(text))
    listed = lambda c: F.when(F.trim(c).startswith("["), c)
    under = F.coalesce(*(listed(F.get_json_object(text, f"$.{k}")) for k in keys))
    anywhere = F.get(F.filter(F.map_values(F.from_json(text, ROW)), lambda v: F.coalesce(v.rlike(r"^\s*\[\s*\{"), F.lit(False))), 0)
    found = F.when(trimmed.startswith("["), F.col(text)).otherwise(F.coalesce(under, anywhere))
    return payloads.select(*keep, F.posexplode(objects(found)).alias("_at", "_row")).select(*keep, (F.col("_at") + 1).alias("rank"), F.from_json("_row", ROW).alias("row"))


def of(*names: str, row: str = "row") -> Column:
    """The first of the fields that a row has a value for."""
    return F.coalesce(*(text_or_null(F.col(row)[n]) for n in names))


def with_fields(rows: DataFrame, row: str = "row") -> DataFrame:
    """``rows`` with the fields of a row by names in plain letters and digits, so that spelling, case and signs don't matter, and
    their values, each made once for all that ask for them."""
    names = F.transform(F.map_keys(row), lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", ""))
    return rows.withColumns({"_names": names, "_values": F.transform(F.map_values(row), text_or_null)})


def named(*names: str) -> Column:
    """The first of the fields that has a value, by plain names."""
    plain = ["".join(x for x in n.lower() if x.isalnum() and x.isascii()) for n in names]
    return F.coalesce(*(F.get("_values", F.array_position("_names", n).cast("int") - 1) for n in plain))


def yes_or_no(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def first_of_symbol(rows: DataFrame, order_col: str, symbol_col: str = "symbol") -> DataFrame:
    """The first row of each symbol, whatever its case."""
    rest = [c for c in rows.columns if c != symbol_col]
    best = rows.where(F.col(symbol_col).isNotNull()).groupBy(F.upper(symbol_col).alias(symbol_col)).agg(F.min_by(F.struct(*rest), order_col).alias("_row"))
    return best.select(symbol_col, "_row.*").select(rows.columns)


def last_prices(payloads: DataFrame, text: str, known: DataFrame, *keep: str) -> DataFrame:
    """``{"data": {key: {ltp, ltq, cp, volume, ltt}}}`` to quotes; ``known`` (instrument_key, instrument_id) names them, others keep
    their key as id. Entries that are not objects are left out."""
    quote = "struct<ltp:string,ltq:string,cp:string,volume:string,ltt:string,last_trade_time:string>"
    entries = F.map_filter(F.from_json(F.get_json_object(text, "$.data"), ROW), lambda _, v: F.coalesce(F.trim(v).startswith("{"), F.lit(False)))
    rows = payloads.select(*keep, F.explode(entries).alias("instrument_key", "q")).withColumn("q", F.from_json("q", quote))
    named = rows.join(known.select("instrument_key", F.col("instrument_id").alias("_known")), "instrument_key", "left")
    return named.select(
        *keep, F.coalesce("_known", "instrument_key").alias("instrument_id"), "instrument_key",
        F.coalesce(F.try_to_timestamp("q.ltt"), F.try_to_timestamp("q.last_trade_time")).alias("observed_at"),
        number(F.col("q.ltp")).alias("last_price"), number(F.col("q.ltq")).cast("long").alias("last_trade_quantity"),
        number(F.col("q.cp")).alias("previous_close"), number(F.col("q.volume")).cast("long").alias("volume"),
    )


def shareholding(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    rows = payload_rows(payloads, text, *keep)
    return rows.select(
        *keep, period_end(of("date", "as on", "as_on_date", "period")).alias("period_end"),
        number(of("pr_and_prgrp", "promoter", "promoter_and_promoter_group")).alias("promoter"),
        number(of("public_val", "public", "public_shareholding")).alias("public"),
        number(of("employeeTrusts", "employee_trusts")).alias("employee_trusts"),
        day(of("broadcastDateTime", "broadcast_date_time", "submissionDate", "submission_date")).alias("published_on"),
        F.sha2(F.coalesce(of("recordId", "record_id", "xbrl", "date"), F.to_json("row")), 256).alias("raw_ref"),
    )


def exchange_actions(df: DataFrame, on: Column) -> DataFrame:
    """An exchange's file of corporate actions to typed rows."""
    get = lambda *names: text_or_null(column_named(df, *names))
    action = F.coalesce(get("PURPOSE", "ACTION", "CORPORATE_ACTION"), F.lit("unknown"))
    return df.select(
        F.coalesce(get("SYMBOL", "SYMBOL_NAME", "SECURITY_SYMBOL"), F.lit("UNKNOWN")).alias("instrument_id"),
        F.replace(F.replace(F.lower(action), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")).alias("action_type"), on.alias("announcement_date"),
        *(day(get(*names)).alias(n) for n, names in {
            "ex_date": ("EX-DATE", "EX DATE", "EX_DATE"), "record_date": ("RECORD DATE", "RECORD_DATE"),
            "book_closure_start": ("BOOK CLOSURE START DATE",), "book_closure_end": ("BOOK CLOSURE END DATE",),
        }.items()),
        get("FACE VALUE", "FACE_VALUE").alias("face_value"), get("COMPANY NAME", "SECURITY_NAME").alias("company_name"), get("SERIES").alias("series"),
    )


def exchange_events(df: DataFrame, kind: str, on: Column) -> DataFrame:
    """An exchange's file of announcements to events; ids are 24 hex digits of what tells events apart."""
    get = lambda *names: text_or_null(column_named(df, *names))
    rows = df.select(
        get("SYMBOL", "SYMBOL_NAME", "SECURITY_SYMBOL").alias("instrument_id"), F.lit(kind).alias("event_type"), on.alias("event_date"),
        get("SUBJECT", "PURPOSE", "DESCRIPTION", "TITLE").alias("subject"), get("DETAILS", "DESCRIPTION", "TEXT", "REMARKS").alias("description"),
        get("URL", "ATTACHMENT", "FILE", "LINK").alias("url"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("event_type", "instrument_id", "event_date", "subject", "description")]
    return rows.select(F.substring(content_id(*parts), 1, 24).alias("event_id"), *rows.columns)


def asset_links(row: Column) -> Column:
    """Distinct addresses of documents in a row, in order: whole fields named like documents, then addresses in any text."""
    fields = F.filter(F.map_entries(row), lambda e: F.lower(e["key"]).rlike(DOCUMENT_FIELDS) & F.trim(e["value"]).rlike("^(?:https?://|/)"))
    whole = F.transform(fields, lambda e: F.trim(e["value"]))
    free = F.flatten(F.transform(F.filter(F.map_values(row), lambda v: v.isNotNull()), lambda v: F.regexp_extract_all(v, F.lit(r"""(https?://[^\s<>"]+)"""), F.lit(1))))
    named = F.transform(F.filter(free, lambda u: u.rlike(DOCUMENT_ENDINGS)), lambda u: F.regexp_replace(u, r"[.,);\]]+$", ""))
    return F.array_distinct(F.concat(whole, named))


def filings(payloads: DataFrame, category: str, text: str, *keep: str) -> DataFrame:
    """Filing rows, wherever the payload keeps them, with ids from their content, periods, times, and their documents in ``assets``."""
    rows = with_fields(nested.nested_rows(payloads, text, *keep, keys=FILING_KEYS)).withColumn("assets", asset_links(F.col("row")))
    symbol = F.upper(named("symbol", "sm_symbol", "nse_symbol"))
    sorted_row = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("row"))))
    # fixed values: the fields that an id is made of
    period, published = named("toDate", "to_date", "quarterEndDate", "quarter_end_date", "fromYear", "from_year"), named("filingDate", "filing_date", "broadcastDateTime", "broadcast_date_time", "sort_date")
    parts = [F.lit("nse"), F.lit(category), F.coalesce(symbol, F.lit("")), F.coalesce(period, F.lit("")), F.coalesce(published, F.lit("")), F.array_join("assets", "|"), sorted_row]
    # fixed values: the fields of filings
    filing_type = F.coalesce(named("filingType", "filing_type", "type", "desc", "subject", "purpose", "reportType"), F.lit(category))
    details = named("details", "detailsUrl", "details_url", "detailUrl", "link")
    # read by names once, before the grammar of dates asks for them many times
    rows = rows.withColumns({
        "_period_start": named("fromDate", "from_date", "periodStartDate", "period_start"),
        "_period_end": named("toDate", "to_date", "quarterEndDate", "quarter_end_date", "periodEndDate", "period_end"),
        "_published_at": named("an_dt", "announcementDateTime", "announcement_datetime", "broadcastDateTime", "broadcast_date_time", "filingDate", "filing_date", "sort_date", "submissionDate", "submission_date"),
        "_received_at": named("exchangeReceivedTime", "exchange_received_time", "receivedTime", "received_time"),
        "_revised_at": named("revisedDateTime", "revised_date_time", "revisedDate", "revised_date"),
    })
    return rows.select(
        *keep, short_id(f"nse:{category}:", *parts, length=32).alias("filing_id"), F.concat(F.lit("NSE:"), symbol).alias("instrument_id"), symbol.alias("symbol"),
        named("companyName", "company_name", "sm_name", "issuer").alias("company_name"), filing_type.alias("filing_type"), F.lit(category).alias("category"),
        named("desc", "subject", "reportType", "type").alias("subcategory"),
        F.coalesce(named("title", "subject", "attchmntText", "desc", "reportType", "type"), filing_type).alias("title"),
        day(F.col("_period_start")).alias("period_start"),
        day(F.col("_period_end")).alias("period_end"),
        named("financialYear", "financial_year", "fromYear", "from_year").alias("financial_year"),
        named("consolidated", "consolidatedStandalone", "statementType", "statement_type").alias("statement_type"),
        named("typeOfSubmission", "type_of_submission", "submissionType", "submission_type").alias("submission_type"),
        yes_or_no(named("audited", "auditedUnaudited", "auditStatus")).alias("audited"),
        dates.instant(F.col("_published_at")).alias("published_at"),
        dates.instant(F.col("_received_at")).alias("received_at"),
        dates.instant(F.col("_revised_at")).alias("revised_at"),
        named("revisionRemarks", "revision_remarks").alias("revision_remarks"), F.when(details.rlike("^https?://"), details).alias("details_url"), "assets",
    )


def filing_assets(found: DataFrame, *also: str) -> DataFrame:
    """The documents of filings, with the columns ``also`` of their filing."""
    rows = found.select("filing_id", *also, F.posexplode("assets").alias("position", "url"))
    return rows.select("filing_id", *also, "position", "url", document_type(F.col("url"), F.lit(None).cast("string")).alias("document_type"))


def index_snapshots(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    rows = payload_rows(payloads, text, *keep)
    symbol = of("indexSymbol", "index", "indexName")
    numbers = {
        "value": ("last", "lastPrice", "value"), "change": ("variation", "change"), "change_percent": ("percentChange", "pChange", "changePercent"),
        "previous_close": ("previousClose", "prevClose"), "open": ("open",), "high": ("high", "dayHigh"), "low": ("low", "dayLow"),
        "year_high": ("yearHigh", "yearlyHigh"), "year_low": ("yearLow", "yearlyLow"),
        "one_year_return_percent": ("perChange365d", "pChange365d"), "one_month_return_percent": ("perChange30d", "pChange30d"),
    }
    found = rows.select(*keep, symbol.alias("index_symbol"), F.coalesce(of("index", "indexName"), symbol).alias("index_name"), *(number(of(*names)).alias(n) for n, names in numbers.items()))
    return found.where("index_symbol IS NOT NULL")


def sector_classification(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    get = lambda *names: F.coalesce(*(text_or_null(F.get_json_object(text, f"$.{part}.{n}")) for part in ("industryInfo", "metadata") for n in names))
    return payloads.select(*keep, get("macro").alias("sector_macro"), get("sector").alias("sector"), get("industry").alias("industry"), get("basicIndustry", "basic_industry").alias("basic_industry"))


def regulatory_items(rows: DataFrame, category: str) -> DataFrame:
    """Listing rows (title, published_at, detail_url, links, document_urls) to items with ids of 32 hex digits; all links, each once."""
    parts = [F.lit("sebi"), F.lit(category), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "published_at", "detail_url"))]
    none = F.array().cast("array<string>")
    documents = F.coalesce("document_urls", none)
    return rows.select(
        short_id("sebi:", *parts, length=32).alias("regulatory_id"), F.lit(category).alias("category"), F.trim("title").alias("title"), "published_at", "detail_url",
        documents.alias("document_urls"), F.array_distinct(F.concat(F.coalesce("links", none), documents)).alias("links"),
    )


def regulatory_documents(items: DataFrame) -> DataFrame:
    """A row for each document of each item."""
    rows = items.select("regulatory_id", "title", F.explode("document_urls").alias("url"))
    return rows.select(short_id("sebi:", F.col("url"), length=32).alias("document_id"), "regulatory_id", "title", "url")


#: The fields of insiders' transactions and large deals.
INSIDER_TEXTS = {
    "company_name": ("company",), "regulation": ("anex", "regulation"), "person_name": ("acqName", "name of the acquirer/disposer"), "person_category": ("personCategory", "category of person"),
    "security_type_prior": ("secType", "type of security (prior)"), "security_type_acquired": ("tkdAcqm", "type of security (acquired/dispclosed)"),
    "transaction_type": ("tdpTransactionType", "acquisition/disposal transaction type"), "security_type_post": ("securitiesTypePost", "type of security (post)"),
    "mode": ("acqMode", "mode of acquisition"), "derivative_type": ("derivativeType", "derivative type security"),
    "derivative_contract_type": ("tdpDerivativeContractType", "derivative contract specification"), "exchange": ("exchange",), "remarks": ("remarks", "remark"), "xbrl_url": ("xbrl",),
}
INSIDER_NUMBERS = {
    "securities_prior": ("befAcqSharesNo", "no. of security (prior)"), "holding_percent_prior": ("befAcqSharesPer", "% shareholding (prior)"),
    "securities_acquired": ("secAcq", "no. of securities (acquired/dispclosed)"), "transaction_value": ("secVal", "value of security (acquired/dispclosed)"),
    "securities_post": ("afterAcqSharesNo", "no. of security (post)"), "holding_percent_post": ("afterAcqSharesPer", "% post"), "buy_value": ("buyValue", "notional value(buy)"),
    "buy_quantity": ("buyQuantity", "number of units/contract lot size (buy)"), "sell_value": ("sellValue", "notional value(sell)"),
    "sell_quantity": ("sellquantity", "number of units/contract lot size (sell)"),
}
DEAL_KEYS = {"bulk_deals": "BULK_DEALS_DATA", "block_deals": "BLOCK_DEALS_DATA", "short_deals": "SHORT_DEALS_DATA"}
#: The fields of an index's members.
MEMBER_NUMBERS = {
    "weight_percent": ("weight", "weightage", "indexWeight"), "price": ("lastPrice", "ltp", "price"), "change": ("change", "variation"), "change_percent": ("pChange", "percentChange", "changePercent"),
    "market_cap": ("marketCap", "marketCapitalisation"), "free_float_market_cap": ("ffmc", "freeFloatMarketCap", "freeFloatMcap"), "traded_value": ("totalTradedValue", "tradedValue"),
}


def row_id(prefix: str, row: str = "row") -> Column:
    """An id from all fields of a row, whatever their order."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(row)))), 256))


def insider_transactions(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    """Insiders' transactions as regulators publish them, one row each, under the short or the long names of the fields."""
    rows = with_fields(payload_rows(payloads, text, *keep))
    symbol = F.upper(named("symbol"))
    return rows.select(
        *keep, row_id("nse:insider:").alias("event_id"), F.concat(F.lit("NSE:"), symbol).alias("instrument_id"), symbol.alias("symbol"),
        *(named(*names).alias(n) for n, names in INSIDER_TEXTS.items()), *(number(named(*names)).alias(n) for n, names in INSIDER_NUMBERS.items()),
        day(named("acqfromDt", "date of allotment/acquisition from")).alias("acquisition_from"), day(named("acqtoDt", "date of allotment/acquisition to")).alias("acquisition_to"),
        dates.instant(named("intimDt", "date of initmation to company")).alias("intimation_date"), dates.instant(named("date", "broadcast date and time")).alias("broadcast_at"),
    )


def large_deals(payloads: DataFrame, mode: str, text: str, *keep: str) -> DataFrame:
    """Bulk, block or short deals of a day's snapshot."""
    listed = payloads.select(*keep, F.get_json_object(text, f"$.{DEAL_KEYS[mode]}").alias("_deals"))
    rows = with_fields(payload_rows(listed, "_deals", *keep))
    return rows.select(
        *keep, row_id(f"nse:{mode}:").alias("event_id"), F.upper(named("symbol")).alias("symbol"), named("name", "company").alias("company_name"), F.lit(mode).alias("deal_type"),
        day(named("date", "trade_date")).alias("trade_date"), named("clientName", "client_name").alias("client_name"), named("buySell", "buy_sell", "side").alias("side"),
        number(named("qty", "quantity")).alias("quantity"), number(named("watp", "weighted_average_price")).alias("weighted_average_price"), named("remarks", "remark").alias("remarks"),
    )


def index_constituents(payloads: DataFrame, text: str, *keep: str, known: DataFrame | None = None) -> DataFrame:
    """The members of an index; ranks count the rows of the payload, of which those without a symbol are left out. ``known``
    (symbol, instrument_id) names instruments."""
    about = lambda n: text_or_null(F.get_json_object(text, f"$.metadata.{n}"))
    top = payloads.select(*keep, text, F.coalesce(about("indexName"), about("name"), about("index")).alias("_name"), about("indexSymbol").alias("_symbol"))
    rows = with_fields(payload_rows(top, text, *keep, "_name", "_symbol"))
    rows = rows.withColumn("symbol", F.upper(named("symbol", "symbolName", "ticker"))).where("symbol IS NOT NULL")
    if known is not None:
        rows = rows.join(known.select(F.upper("symbol").alias("symbol"), "instrument_id"), "symbol", "left")
    else:
        rows = rows.withColumn("instrument_id", F.lit(None).cast("string"))
    index = F.coalesce(named("indexSymbol", "index", "indexName"), "_symbol", "_name")
    return rows.select(
        *keep, index.alias("index_symbol"), F.coalesce("_name", index).alias("index_name"), "instrument_id", "symbol", named("identifier", "companyName", "company").alias("company_name"), "rank",
        *(number(named(*names)).alias(n) for n, names in MEMBER_NUMBERS.items()), number(named("totalTradedVolume", "volume")).cast("long").alias("volume"),
    )
