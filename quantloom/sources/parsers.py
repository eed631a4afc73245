"""Landed payloads to typed rows: candles, quotes, statements, actions, macro tables, feeds, filings, instrument files.

Providers can't be reached from tasks, so a source is what was landed (JSON, CSV, XML or HTML text in a column, or
files that ``read_landed`` opens), and a parser is a projection over it. Values that don't fit become null, and rows
that can't be used come out of ``rejected`` rather than failing the job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import content_id
from quantloom.operators.identity import canonical_instrument_id
from quantloom.sources import dates, references

#: Texts that stand for no value.
BLANK = ("", "-", "None", "nan", "NaN", "NAN", "null", "N/A")


def read_landed(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options) -> DataFrame:
    """Files of one kind: json (one object a line, or with ``multiLine`` one array or object a file; .gz is read too), csv, text
    (whole files) or binary. Where nothing has landed the result is an empty table of ``schema``; without one it is an error."""
    if schema:
        try:
            return read_landed(spark, path, kind, **options) if kind != "json" else spark.read.schema(schema).options(**options).json(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
    if kind == "json":
        return spark.read.options(**options).option("mode", "PERMISSIVE").json(path)
    if kind == "csv":
        return spark.read.options(header=True, **options).csv(path)
    if kind == "text":
        return spark.read.options(wholetext=True, **options).text(path)
    return spark.read.format("binaryFile").options(**options).load(path)


def text_or_null(c: Column) -> Column:
    c = F.trim(c.cast("string"))
    return F.when(~c.isin(*BLANK), c)


def number(c: Column) -> Column:
    """Numbers with thousands separators or a per cent sign."""
    return F.regexp_replace(text_or_null(c), "[,%]", "").try_cast("double")


def day(c: Column) -> Column:
    """Dates in any form that ``dates`` knows; a month stands for its first day."""
    return dates.day(c)


def period_end(label: Column) -> Column:
    """The last day of the month that a label like ``Mar 2024`` or ``2024-03-31`` names."""
    return F.last_day(day(label))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def short_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(content_id(*parts), 1, length))


def column_named(df: DataFrame, *aliases: str) -> Column:
    """The first of ``aliases`` that is a column of ``df``, whatever its case, spaces and underscores; else null.

    The first column that exists counts, even where it is null."""
    plain = lambda x: "".join(ch for ch in x.lower() if ch.isalnum())
    there = {plain(c): c for c in reversed(df.columns)}
    found = next((there[plain(a)] for a in aliases if plain(a) in there), None)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def rejected(df: DataFrame, wanted: Column, id_col: str, reason: str) -> DataFrame:
    """Issue rows for records without what a parser needs."""
    return df.where(wanted.isNull()).select(F.col(id_col).cast("string").alias("record"), F.lit(reason).alias("code"))


def issues(*found: tuple[str, str, DataFrame]) -> DataFrame:
    """(source, operation, …, code, detail): the issues of several (source, operation, rows) as one table."""
    tables = []
    for source, operation, rows in found:
        rows = rows if "detail" in rows.columns else rows.withColumn("detail", F.lit(None).cast("string"))
        tables.append(rows.select(F.lit(source).alias("source"), F.lit(operation).alias("operation"), *(c for c in rows.columns if c not in ("code", "detail")), "code", "detail"))
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


# ---- prices ----


def candles(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """``{"data": {"candles": [[time, open, high, low, close, volume], ...]}}`` to bars; shorter rows are left out."""
    rows = payloads.select(*keep, F.explode(F.from_json(F.get_json_object(text, "$.data.candles"), "array<array<string>>")).alias("c")).where(F.size("c") >= 6)
    at = lambda k: F.col("c")[k]
    names = ("open", "high", "low", "close", "volume")
    return rows.select(*keep, at(0).try_cast("timestamp").alias("ts"), *(at(k).try_cast("double").alias(n) for k, n in enumerate(names, 1)))


def short_candles(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    rows = payloads.select(*keep, F.explode(F.from_json(F.get_json_object(text, "$.data.candles"), "array<array<string>>")).alias("c"))
    return rows.where(F.size("c") < 6).select(*keep, F.lit("short_candle").alias("code"))


#: Fields of a quote and the names that payloads have for them, the preferred one first.
QUOTE_NUMBERS = {
    "last_price": ("last_price", "ltp"), "previous_close": ("prev_close_price",), "net_change": ("net_change",), "year_high": ("year_high",), "year_low": ("year_low",),
    "average_price": ("average_price",), "circuit_upper": ("upper_circuit_limit",), "circuit_lower": ("lower_circuit_limit",),
    "indicative_equilibrium_price": ("indicative_equilibrium_price",), "reference_price": ("reference_price",),
}
QUOTE_COUNTS = {
    "last_trade_quantity": ("last_trade_quantity", "ltq"), "total_buy_quantity": ("total_buy_quantity",), "total_sell_quantity": ("total_sell_quantity",), "open_interest": ("oi",),
    "previous_oi": ("previous_oi",), "oi_day_high": ("oi_day_high",), "oi_day_low": ("oi_day_low",), "indicative_equilibrium_quantity": ("indicative_equilibrium_quantity",),
    "indicative_imbalance_quantity_total": ("indicative_imbalance_quantity_total",), "indicative_imbalance_quantity_market": ("indicative_imbalance_quantity_market",),
}


def quote_entries(payloads: DataFrame, text: str, *keep: str) -> DataFrame:
    """(…, instrument_key, quote): the entries of ``{"data": {key: ...}}``, each as its own JSON text."""
    return payloads.select(*keep, F.explode(F.from_json(F.get_json_object(text, "$.data"), "map<string,string>")).alias("instrument_key", "quote"))


def quotes(payloads: DataFrame, text: str = "payload", *keep: str, known: DataFrame | None = None, retrieved_at: Column | None = None) -> DataFrame:
    """``{"data": {key: {last_price, ohlc, depth, ...}}}`` to a row for each key. Every entry is read by itself, so one that is
    no object loses only itself (``not_quotes`` names it). ``known`` (instrument_key, instrument_id) names keys, others
    keep theirs as id. Day prices come from ``ohlc``, else from ``live_ohlc``; a quote without a time that can be read has that
    of its retrieval. Depth stays as lists of levels."""
    rows = quote_entries(payloads, text, *keep).where(F.trim("quote").startswith("{"))
    get = lambda *paths: F.coalesce(*(text_or_null(F.get_json_object("quote", f"$.{p}")) for p in paths))
    is_object = lambda p: F.coalesce(F.trim(F.get_json_object("quote", f"$.{p}")).startswith("{"), F.lit(False))
    ohlc = lambda name: F.when(is_object("ohlc"), get(f"ohlc.{name}")).otherwise(get(f"live_ohlc.{name}"))
    level = "struct<price:double,quantity:long,orders:long>"
    listed = lambda name: F.filter(F.from_json(F.get_json_object("quote", f"$.depth.{name}"), "array<string>"), lambda x: F.trim(x).startswith("{"))
    side = lambda name: F.coalesce(F.transform(listed(name), lambda x: F.from_json(x, level)), F.array().cast(f"array<{level}>"))
    whole = lambda c: number(c).cast("long")
    when = get("timestamp")
    at = F.when(when.rlike(r"^[0-9.]+$"), dates.from_millis(when)).otherwise(F.try_to_timestamp(when))
    orders = F.aggregate(F.concat("bid_depth", "ask_depth"), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["orders"], F.lit(0)))
    if known is not None:
        rows = rows.join(known.select("instrument_key", F.col("instrument_id").alias("_known")), "instrument_key", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    return rows.select(
        *keep, F.coalesce("_known", "instrument_key").alias("instrument_id"), "instrument_key",
        F.coalesce(at, *([] if retrieved_at is None else [retrieved_at])).alias("timestamp"),
        *(number(get(*names)).alias(n) for n, names in QUOTE_NUMBERS.items()), *(number(ohlc(n)).alias(f"day_{n}") for n in ("open", "high", "low")), number(ohlc("close")).alias("close"),
        F.coalesce(whole(get("volume")), whole(ohlc("volume"))).alias("volume"), *(whole(get(*names)).alias(n) for n, names in QUOTE_COUNTS.items()),
        dates.from_millis(get("last_trade_time")).alias("last_trade_time"), dates.from_millis(ohlc("ts")).alias("ohlc_timestamp"),
        side("buy").alias("bid_depth"), side("sell").alias("ask_depth"), get("cas_eligible").try_cast("boolean").alias("cas_eligible"),
    ).withColumn("order_count", orders)


def not_quotes(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """Issue rows for entries that are no objects."""
    bad = quote_entries(payloads, text, *keep).where(~F.coalesce(F.trim("quote").startswith("{"), F.lit(False)))
    return bad.select(*keep, "instrument_key", F.lit("not_a_quote").alias("code"), F.col("quote").alias("detail"))


def daily_universe(df: DataFrame) -> DataFrame:
    """An exchange's daily file to bars: ISIN, else exchange and symbol, as id; midnight of the exchange in UTC."""
    get = lambda *names: column_named(df, *names)
    rows = df.select(
        text_or_null(get("isin", "isin_code")).alias("isin"), F.lit("NSE").alias("exchange"), text_or_null(get("symbol", "ticker")).alias("symbol"),
        day(get("date", "trade_date", "timestamp")).alias("d"),
        *(number(get(*names)).alias(n) for n, names in {
            "open": ("open", "open_price"), "high": ("high", "high_price"), "low": ("low", "low_price"), "close": ("close", "close_price"),
            "volume": ("volume", "ttl_trd_qnty", "tottrdqty"), "traded_value": ("turnover_lacs", "traded_value", "tottrdval"), "delivery_percent": ("deliv_per", "delivery_percent"),
        }.items()),
    )
    rows = rows.where("symbol IS NOT NULL").withColumn("instrument_id", canonical_instrument_id())
    return rows.withColumn("ts", F.to_utc_timestamp(F.col("d").cast("timestamp"), "Asia/Kolkata")).drop("d", "exchange")


# ---- statements and corporate records ----


def statement_snapshots(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """Statement histories to one value a row: (…, period_end, period_type, statement_type, units_in, part, name, value, change).

    Categories with a history become names under ``summary`` (a particular, or ``value``, stands in for a missing category),
    particulars under ``full_statement`` (there a category stands in, and groups with neither are left out); a ``history`` of
    whole periods, as balance sheets have it, gives a name for each of its fields. Rows stay long, and ``merged_periods``
    pivots what is needed."""
    group = "array<struct<category:string,particular:string,history:array<struct<period:string,value:string,change:string>>>>"
    get = lambda path: F.get_json_object(text, path)
    about = [F.coalesce(get("$.data.time_period"), F.lit("yearly")).alias("period_type"), get("$.data.type").alias("statement_type"), get("$.data.units_in").alias("units_in")]

    def groups(part: str, path: str, *names: str) -> Column:
        listed = F.coalesce(F.from_json(get(path), group), F.array().cast(group))
        named = lambda g: F.struct(F.lit(part).alias("part"), F.coalesce(*(F.nullif(g[n], F.lit("")) for n in names), *([F.lit("value")] if part == "summary" else [])).alias("name"), g["history"].alias("history"))
        return F.filter(F.transform(listed, named), lambda g: g["name"].isNotNull())

    summaries = [groups("summary", f"$.data.{x}", "category", "particular") for x in ("income_statement", "balance_sheet", "cash_flow")]
    parts = F.concat(*summaries, groups("full_statement", "$.data.full_statement", "particular", "category"))
    cols = ("period_type", "statement_type", "units_in")
    rows = payloads.select(*keep, *about, F.explode(parts).alias("g")).select(*keep, *cols, "g.part", "g.name", F.explode("g.history").alias("h")).where("h.period IS NOT NULL")
    grouped = rows.select(*keep, period_end(F.col("h.period")).alias("period_end"), *cols, "part", "name", number(F.col("h.value")).alias("value"), number(F.col("h.change")).alias("change"))
    whole = payloads.select(*keep, *about, F.explode(F.from_json(get("$.data.history"), "array<map<string,string>>")).alias("h"))
    whole = whole.select(*keep, *cols, F.col("h")["period"].alias("period"), F.explode(F.map_filter("h", lambda k, _: k != "period")).alias("name", "v")).where("period IS NOT NULL")
    return grouped.unionByName(
        whole.select(*keep, period_end(F.col("period")).alias("period_end"), *cols, F.lit("summary").alias("part"), "name", number(F.col("v")).alias("value"), F.lit(None).cast("double").alias("change"))
    )


def corporate_actions(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """``{"data": [{"name", "expiry_date", "amount", "ratio", "event_details": [{"name", "value"}]}]}`` to typed rows; entries that
    are no objects are left out."""
    rows = payloads.select(*keep, F.explode(F.from_json(F.get_json_object(text, "$.data"), "array<string>")).alias("a")).where(F.trim("a").startswith("{"))
    entries = F.transform(F.from_json(F.get_json_object("a", "$.event_details"), "array<string>"), lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.value").alias("value")))
    # fixed values: the names of the details
    said = lambda *names: F.coalesce(*(text_or_null(F.get(F.filter(entries, lambda e: e["name"] == n), 0)["value"]) for n in names))  # noqa: B023, E731
    get = lambda n: text_or_null(F.get_json_object("a", f"$.{n}"))
    return rows.select(
        *keep, F.replace(F.lower(F.coalesce(get("name"), F.lit("unknown"))), F.lit(" "), F.lit("_")).alias("action_type"),
        day(said("Announcement date")).alias("announcement_date"),
        day(F.coalesce(said("Ex dividend date", "Ex-Date", "Ex date", "Ex Date"), get("expiry_date"))).alias("ex_date"),
        day(said("Record date", "Record Date")).alias("record_date"), get("amount").try_cast("double").alias("amount"), get("ratio").alias("ratio"),
    )


#: Fields of macro tables.
MACRO_DATES = ("date", "observation_date", "period", "month", "year")
MACRO_VALUES = ("value", "index", "inflation", "rate", "value_numeric")
MACRO_SERIES = ("series", "series_id", "series_code", "item", "group")


def macro_observations(
    df: DataFrame, dataset: str, series: Column | None = None, date_fields: tuple[str, ...] = MACRO_DATES, value_fields: tuple[str, ...] = MACRO_VALUES, unit: Column | None = None
) -> DataFrame:
    """(series_id, observation_date, value, value_text, unit) of the rows that have a date and something as value; what is no
    number stays as text. A series is the given one, else what the row says, else the dataset."""
    get = lambda *names: text_or_null(column_named(df, *names))
    own_series, own_unit = get(*MACRO_SERIES), get("unit", "units")
    rows = df.select(
        F.coalesce(*([] if series is None else [series]), own_series, F.lit(dataset)).alias("series_id"), day(column_named(df, *date_fields)).alias("observation_date"),
        number(column_named(df, *value_fields)).alias("value"), get(*value_fields).alias("value_text"), (own_unit if unit is None else F.coalesce(unit, own_unit)).alias("unit"),
    )
    return rows.where("observation_date IS NOT NULL AND value_text IS NOT NULL")


def instruments(df: DataFrame) -> DataFrame:
    """Instrument files to the dimension: exchange spelled alike, id by precedence."""
    get = lambda *names: text_or_null(column_named(df, *names))
    rows = df.select(
        get("isin").alias("isin"), F.upper(F.regexp_extract(get("exchange", "segment"), r"^([A-Za-z]+)", 1)).alias("exchange"), F.upper(get("trading_symbol", "tradingsymbol", "symbol")).alias("symbol"),
        get("name", "company_name").alias("name"), get("instrument_key").alias("instrument_key"), get("exchange_token").alias("exchange_token"), get("instrument_type", "security_type").alias("security_type"),
    )
    return rows.withColumn("instrument_id", canonical_instrument_id()).where("instrument_id IS NOT NULL")


# ---- documents ----


def document_type(url: Column, mime: Column) -> Column:
    """By words in the media type and the address; the first rule that fits wins."""
    # fixed values: the words and their order
    v = F.lower(F.concat_ws(" ", F.coalesce(mime, F.lit("")), F.coalesce(url, F.lit(""))))
    has = lambda *words: v.rlike("|".join(words))
    return (
        F.when(has("pdf"), "pdf").when(has("xml", "xbrl"), "xbrl_xml").when(has("xlsx", "spreadsheetml", r"\.xls\s*$"), "xlsx")
        .when(has("zip"), "zip").when(has("csv"), "csv").when(has("html", r"\.htm"), "html").when(has("text/plain", r"\.txt"), "text").otherwise("unknown")
    )


def without_markup(text: Column) -> Column:
    """Character references decoded, tags dropped, white space collapsed; null if nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(references.unescaped(text), "<[^>]+>", " "), r"\s+", " "))
    return F.nullif(text, F.lit(""))


def linked_assets(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Distinct addresses in a text, each with its document type, in order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>]+)"), F.lit(1)))
    rows = df.select(*keep, F.posexplode(found).alias("position", "url"))
    return rows.select(*keep, "position", "url", document_type(F.col("url"), F.lit(None).cast("string")).alias("document_type"))


def from_feed(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """RSS items and Atom entries to news rows, by Spark's own XML functions."""
    item = "struct<title:string,link:string,description:string,summary:string,pubDate:string,guid:string,author:string,category:array<string>>"
    entry = "struct<title:string,link:struct<_href:string>,summary:string,content:string,published:string,updated:string,id:string>"
    rss = F.from_xml(F.col(text), f"channel struct<item:array<{item}>>")["channel"]["item"]
    atom = F.from_xml(F.col(text), f"entry array<{entry}>")["entry"]
    rfc = lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))
    one = lambda t, u, s, p, g: F.struct(without_markup(t).alias("title"), F.trim(u).alias("url"), without_markup(s).alias("summary"), rfc(p).alias("published_at"), g.alias("guid"))
    items = F.transform(rss, lambda x: one(x["title"], x["link"], F.coalesce(x["description"], x["summary"]), x["pubDate"], x["guid"]))
    entries = F.transform(atom, lambda x: one(x["title"], x["link"]["_href"], F.coalesce(x["summary"], x["content"]), F.coalesce(x["published"], x["updated"]), x["id"]))
    rows = payloads.select(*keep, F.explode(F.when(F.size(F.coalesce(items, F.array())) > 0, items).otherwise(entries)).alias("n")).select(*keep, "n.*")
    return rows.withColumn("news_id", short_id("news:", F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")), length=32))


def news_items(payloads: DataFrame, text: str = "payload", *keep: str) -> DataFrame:
    """A list of news objects, the news in ``content`` or in the object itself, to news rows; ids come from the first of id,
    address, and title with time. Times are texts or seconds."""
    rows = payloads.select(*keep, F.explode(F.from_json(text, "array<string>")).alias("_item")).where(F.trim("_item").startswith("{"))
    get = lambda *paths: F.coalesce(*(F.nullif(F.trim(F.get_json_object("_item", f"$.{p}")), F.lit("")) for p in paths))
    both = lambda *names: [f"{where}{n}" for n in names for where in ("content.", "")]
    when = get("content.pubDate", "pubDate", "content.displayTime", "displayTime", "providerPublishTime")
    at = F.coalesce(F.timestamp_seconds(when.try_cast("long")), F.try_to_timestamp(when))
    title = F.coalesce(get(*both("title")), F.lit(""))
    url = get("content.canonicalUrl.url", "canonicalUrl.url", "content.clickThroughUrl.url", "clickThroughUrl.url", "link")
    name = F.coalesce(get("id", "content.id"), url, F.concat_ws("|", title, F.coalesce(at.cast("string"), F.lit("None"))))
    return rows.select(
        *keep, F.concat(F.lit("yfinance:"), F.substring(F.sha2(name, 256), 1, 32)).alias("news_id"), title.alias("title"), at.alias("published_at"), url.alias("url"),
        get(*both("summary", "description")).alias("summary"), F.coalesce(get(*both("provider.displayName")), F.lit("Yahoo Finance")).alias("source_name"),
    )
