"""Queries of the parsers, indicators, selections and window summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import comparative, indicators
from quantloom.plans import context
from quantloom.plans.catalog import query
from quantloom.plans.comparative_queries import ALIGNED
from quantloom.plans.market_queries import RETURNS, B
from quantloom.sources import dates, markup, parsers
from quantloom.sources.driver_tables import STATEMENTS_SQL, bars, benchmark, read, statements

# ---- parsers: payloads are made of the driver's tables, then parsed ----


@query("prs_04_candles", f"{B} SELECT instrument_id, ts, open, high, low, close, volume FROM bars", "open high low close volume")
def prs_04(spark, d):
    """Each bar as a payload of one candle, so that no instrument's history has to fit in one text."""
    b = bars(spark, d)
    row = F.concat(F.lit('{"data":{"candles":[["'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00",'), F.concat_ws(",", "open", "high", "low", "close", "volume"), F.lit("]]}}"))
    return parsers.candles(b.select("instrument_id", row.alias("payload")), "payload", "instrument_id")


@query("prs_06_full_quotes", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'IN' || s_suppkey ELSE 'K' || s_suppkey END AS instrument_id, 'K' || s_suppkey AS instrument_key,
    CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2026-01-01 00:00:01.5' ELSE TIMESTAMP '2026-01-02 05:00:00' END AS timestamp, s_acctbal AS last_price, 104.0::DOUBLE AS previous_close,
    150.0::DOUBLE AS year_high, 80.0::DOUBLE AS year_low, 103.0::DOUBLE AS day_open, 106.0::DOUBLE AS day_high, 102.0::DOUBLE AS day_low, s_nationkey::BIGINT AS volume, 10::BIGINT AS last_trade_quantity,
    7::BIGINT AS open_interest, TIMESTAMP '2026-01-01' AS ohlc_timestamp, TIMESTAMP '2026-01-01 00:00:01' AS last_trade_time, true AS cas_eligible, s_nationkey::BIGINT + 5 AS order_count FROM supplier""",
    "last_price previous_close year_high year_low day_open day_high day_low")
def prs_06(spark, d):
    """Both spellings of a quote's fields, times in seconds of text and in milliseconds, and an entry that is no object."""
    s = read(spark, d, "supplier")
    ohlc = '{"open":103,"high":106,"low":102,"close":105.25,"volume":%d,"ts":1767225600000}'
    common = '"prev_close_price":104.0,"year_high":150,"year_low":80,"oi":7,"last_trade_time":"1767225601000","cas_eligible":true,"depth":{"buy":[{"price":1,"quantity":2,"orders":%d}],"sell":[{"price":1,"quantity":2,"orders":5},3]}'
    one = '{"status":"success","data":{"bad":3,"K%d":{"ltp":%s,"ltq":10,"timestamp":1767225601500,"live_ohlc":' + ohlc + "," + common + "}}}"
    two = '{"status":"success","data":{"K%d":{"last_price":%s,"last_trade_quantity":10,"timestamp":"2026-01-02T10:30:00+05:30","ohlc":' + ohlc + "," + common + "}}}"
    args = ("s_suppkey", F.col("s_acctbal").cast("string"), "s_nationkey", "s_nationkey")
    text = F.when(F.col("s_suppkey") % 3 == 0, F.format_string(one, *args)).otherwise(F.format_string(two, *args))
    known = s.where("s_suppkey % 2 = 0").select(F.format_string("K%d", "s_suppkey").alias("instrument_key"), F.format_string("IN%d", "s_suppkey").alias("instrument_id"))
    found = parsers.quotes(s.select(F.col("s_suppkey").alias("id"), text.alias("payload")), "payload", "id", known=known)
    return found.select(
        "id", "instrument_id", "instrument_key", "timestamp", "last_price", "previous_close", "year_high", "year_low", "day_open", "day_high", "day_low", "volume", "last_trade_quantity", "open_interest",
        "ohlc_timestamp", "last_trade_time", "cas_eligible", "order_count",
    )


@query("prs_08_statement_payloads", f"""WITH {STATEMENTS_SQL} SELECT instrument_id, period_end, 'quarterly' AS period_type, 'consolidated' AS statement_type, 'summary' AS part, 'Revenue' AS name, round(revenue, 4) AS value FROM statements
    UNION ALL SELECT instrument_id, period_end, 'quarterly', 'consolidated', 'full_statement', 'Total Assets', round(total_assets, 4) FROM statements""", "value")
def prs_08(spark, d):
    s = statements(spark, d)
    point = lambda c: F.format_string('[{"period":"%s","value":"%s"}]', F.date_format("period_end", "MMM yyyy"), F.round(c, 4).cast("decimal(20,4)").cast("string"))
    text = F.format_string('{"data":{"type":"consolidated","time_period":"quarterly","income_statement":[{"category":"Revenue","history":%s}],"full_statement":[{"particular":"Total Assets","history":%s}]}}', point("revenue"), point("total_assets"))
    return parsers.statement_snapshots(s.select("instrument_id", text.alias("payload")), "payload", "instrument_id").drop("units_in", "change")


_REFERENCES = (("caf&eacute;", "café"), ("&#8217;s", "’s"), ("&mdash;", "—"), ("&#x1F600;", "😀"), ("&amp;lt;", "&lt;"), ("&notit;", "¬it;"), ("&#128;", "€"), ("&unknown; & &;", "&unknown; & &;"), ("&copy 1", "© 1"))


@query("prs_17_references", "SELECT o_orderkey, CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_REFERENCES)) + " END || ' ' || o_custkey AS text FROM orders")
def prs_17_references(spark, d):
    said = F.element_at(F.array(*(F.lit(r) for r, _ in _REFERENCES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", parsers.without_markup(F.concat(F.lit("<p>"), said, F.lit("</p>\n <b>"), F.col("o_custkey").cast("string"), F.lit("</b>"))).alias("text"))


#: Forms of one date as Spark writes them; the first days of months are apart.
_FORMS = ("yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "dd-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d yyyy", "yyyy MMM dd", "dd.MM.yy", "yyyyMMdd", "ddMMMyyyy", "'as on' d MMM, yyyy", "EEE, dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd-MMM-yyyy hh:mm a")


@query("prs_09_loose_dates", f"""SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate::TIMESTAMP + CASE WHEN o_orderkey % {len(_FORMS)} >= {len(_FORMS) - 3} THEN INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 30 MINUTE ELSE INTERVAL 0 HOUR END AS at FROM orders""")
def prs_09_loose(spark, d):
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), F.lit(30))
    text = F.element_at(F.array(*(F.date_format(at, f) for f in _FORMS)), (F.col("o_orderkey") % len(_FORMS) + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", dates.day(text).alias("day"), dates.instant(text).alias("at"))


@query("prs_09_period_end", "SELECT o_orderkey, last_day(o_orderdate)::DATE AS period_end FROM orders")
def prs_09(spark, d):
    forms = F.element_at(F.array(*(F.date_format("o_orderdate", f) for f in ("MMM yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "MMMM yyyy", "dd MMM yyyy"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", parsers.period_end(forms).alias("period_end"))


@query("prs_17_without_markup", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html_decoded, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM (
    SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'),
    '&apos;', chr(39)), '&nbsp;', chr(160)), '&mdash;', '—'), '&hellip;', '…'), '&amp;', '&') AS html_decoded FROM pages)""")
def prs_17(spark, d):
    return read(spark, d, "pages").select("page_id", parsers.without_markup(F.col("html")).alias("text"))


_URL = "url || CASE page_id % 6 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/feed.xml' WHEN 2 THEN '/b.xlsx' WHEN 3 THEN '/c.zip' WHEN 4 THEN '/d.csv' ELSE '/e.htm' END"


@query("prs_21_document_type", f"""SELECT page_id, CASE WHEN contains(u, 'pdf') THEN 'pdf' WHEN contains(u, 'xml') OR contains(u, 'xbrl') THEN 'xbrl_xml' WHEN contains(u, 'xlsx') THEN 'xlsx' WHEN contains(u, 'zip') THEN 'zip'
    WHEN contains(u, 'csv') THEN 'csv' WHEN contains(u, 'html') OR contains(u, '.htm') THEN 'html' WHEN contains(u, '.txt') THEN 'text' ELSE 'unknown' END AS document_type FROM (SELECT page_id, lower({_URL}) AS u FROM pages)""")
def prs_21(spark, d):
    return read(spark, d, "pages").select("page_id", parsers.document_type(F.expr(_URL), F.lit(None).cast("string")).alias("document_type"))


@query("prs_22_visible_text")
def prs_22(spark, d):
    return markup.visible_text(read(spark, d, "pages")).select("page_id", "text")


@query("prs_26_instruments", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'IN' || s_suppkey ELSE 'NSE:' || upper(s_name) END AS instrument_id, s_nationkey::VARCHAR AS exchange_token FROM supplier")
def prs_26(spark, d):
    k = F.col("s_suppkey")
    raw = read(spark, d, "supplier").select(F.when(k % 2 == 0, F.concat(F.lit("in"), k.cast("string"))).otherwise("-").alias("ISIN"), F.lit("NSE_EQ").alias("segment"), F.col("s_name").alias("trading_symbol"), F.col("s_nationkey").alias("Exchange Token"))
    return parsers.instruments(raw).select("instrument_id", "exchange_token")


@query("prs_28_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders", "value")
def prs_28(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit("%")))
    return read(spark, d, "orders").select("o_orderkey", parsers.number(text).alias("value"))


# ---- indicators ----

_RANGE = "OVER (PARTITION BY instrument_id ORDER BY ts ROWS {n} PRECEDING)"


def over(n: int) -> str:
    return _RANGE.format(n=n - 1)


@query("bkd_01_bollinger", f"{B}, x AS (SELECT *, avg(close) {over(20)} AS middle, stddev_pop(close) {over(20)} AS s, count(*) {over(20)} AS n FROM bars) SELECT instrument_id, ts, round(middle, 4) AS middle, round(middle + 2 * s, 4) AS upper, round(middle - 2 * s, 4) AS lower FROM x WHERE n = 20", "middle upper lower")
def bkd_bollinger(spark, d):
    return indicators.bollinger(bars(spark, d)).select("instrument_id", "ts", *(F.round(c, 4).alias(c) for c in ("middle", "upper", "lower")))


@query("bkd_01_on_balance_volume", f"{B}, x AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS m FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)) SELECT instrument_id, ts, sum(m) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv FROM x", "obv")
def bkd_obv(spark, d):
    return indicators.on_balance_volume(bars(spark, d))


@query("bkd_01_stochastic", f"""{B}, x AS (SELECT *, max(high) {over(14)} AS h, min(low) {over(14)} AS l, count(*) {over(14)} AS n FROM bars),
    k AS (SELECT instrument_id, ts, (close - l) / nullif(h - l, 0) * 100 AS k FROM x WHERE n = 14)
    SELECT instrument_id, ts, k, CASE WHEN count(k) {over(3)} = 3 THEN avg(k) {over(3)} END AS d, k - 100 AS williams_r FROM k""", "k d williams_r")
def bkd_stochastic(spark, d):
    return indicators.stochastic(bars(spark, d))


@query("bkd_01_true_range", f"""{B}, x AS (SELECT *, lag(close) OVER w AS p FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)), t AS (SELECT instrument_id, ts, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM x),
    a AS (SELECT *, avg(tr) {over(14)} AS atr, count(tr) {over(14)} AS n FROM t) SELECT instrument_id, ts, tr, atr FROM a WHERE n = 14""", "tr atr")
def bkd_true_range(spark, d):
    return indicators.true_range(bars(spark, d))


@query("bkd_01_directional_movement", f"""WITH RECURSIVE {B.replace("WITH ", "", 1)}, c AS (SELECT instrument_id, ts, high, low, row_number() OVER w - 1 AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
      high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
    m AS (SELECT instrument_id, ts, i, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS n FROM c WHERE i > 0),
    s AS (SELECT instrument_id, 14::BIGINT AS i, avg(tr) AS tr, avg(p) AS p, avg(n) AS n FROM m WHERE i <= 14 GROUP BY 1 HAVING count(*) = 14
      UNION ALL SELECT s.instrument_id, m.i, (s.tr * 13 + m.tr) / 14, (s.p * 13 + m.p) / 14, (s.n * 13 + m.n) / 14 FROM s JOIN m ON m.instrument_id = s.instrument_id AND m.i = s.i + 1),
    d AS (SELECT instrument_id, i, i - 13 AS k, CASE WHEN p + n = 0 THEN 0 ELSE 100 * abs(p - n) / (p + n) END AS x FROM s),
    a AS (SELECT instrument_id, 14::BIGINT AS k, avg(x) AS y FROM d WHERE k <= 14 GROUP BY 1 HAVING count(*) = 14
      UNION ALL SELECT a.instrument_id, d.k, (a.y * 13 + d.x) / 14 FROM a JOIN d ON d.instrument_id = a.instrument_id AND d.k = a.k + 1)
    SELECT m.instrument_id, m.ts, s.tr AS atr, 100 * s.p / s.tr AS plus_di, 100 * s.n / s.tr AS minus_di, a.y AS adx FROM s JOIN m ON m.instrument_id = s.instrument_id AND m.i = s.i
    LEFT JOIN a ON a.instrument_id = s.instrument_id AND a.k = s.i - 13""", "atr plus_di minus_di adx")
def bkd_directional(spark, d):
    return indicators.directional_movement(bars(spark, d))


@query("bkd_01_moving_averages", f"""{B}, x AS (SELECT instrument_id, ts, avg(close) {over(20)} AS a, count(*) {over(20)} AS na, avg(close) {over(50)} AS b, count(*) {over(50)} AS nb FROM bars)
    SELECT instrument_id, ts, 20 AS "window", a AS value FROM x WHERE na = 20 UNION ALL SELECT instrument_id, ts, 50, b FROM x WHERE nb = 50""", "value")
def bkd_moving(spark, d):
    return indicators.moving_averages(bars(spark, d))


@query("exp_06_text_parts", """WITH l AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0)
    SELECT doc_id, k::INT AS part, substr(text, k * 800 + 1, 1000) AS text FROM l, unnest(generate_series(0, greatest(n - 201, 0) // 800)) AS t(k)""")
def exp_06_parts(spark, d):
    return indicators.text_parts(read(spark, d, "documents"), "doc_id", "text")


@query("bkd_02_performance", f"""{RETURNS}, d AS (SELECT instrument_id, ts, close, close / max(close) OVER (PARTITION BY instrument_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars),
    a AS (SELECT instrument_id, CASE WHEN max(ts) > min(ts) THEN pow(arg_max(close, ts) / arg_min(close, ts), 365.2425 / date_diff('day', min(ts), max(ts))) - 1 END AS cagr, min(dd) AS max_drawdown, sqrt(avg(dd * dd)) AS ulcer_index FROM d GROUP BY 1),
    g AS (SELECT instrument_id, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) AS down, sum(r) AS sr FROM r GROUP BY 1),
    mo AS (SELECT r.instrument_id, avg(pow(r.r - g.m, 2)) AS m2, avg(pow(r.r - g.m, 3)) AS m3, avg(pow(r.r - g.m, 4)) AS m4 FROM r JOIN g ON g.instrument_id = r.instrument_id GROUP BY 1),
    k AS (SELECT r.instrument_id, r.r, row_number() OVER (PARTITION BY r.instrument_id ORDER BY r.r, r.ts) AS k, g.n FROM r JOIN g ON g.instrument_id = r.instrument_id),
    t AS (SELECT instrument_id, max(r) AS value_at_risk, avg(r) AS expected_shortfall FROM k WHERE k <= greatest(floor(n * 0.05), 1) GROUP BY 1)
    SELECT a.instrument_id, cagr, max_drawdown, ulcer_index, m / s * sqrt(252) AS sharpe, m / nullif(down, 0) * sqrt(252) AS sortino, s * sqrt(252) AS volatility, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis,
      value_at_risk, expected_shortfall, cagr / nullif(abs(max_drawdown), 0) AS calmar FROM a JOIN g ON g.instrument_id = a.instrument_id JOIN mo ON mo.instrument_id = a.instrument_id JOIN t ON t.instrument_id = a.instrument_id""",
    "cagr max_drawdown ulcer_index sharpe sortino volatility skewness kurtosis value_at_risk expected_shortfall calmar")
def bkd_performance(spark, d):
    return indicators.performance(bars(spark, d))


@query("bkd_02_regression", f"{ALIGNED} SELECT instrument_id, regr_slope(r, b) AS beta, regr_r2(r, b) AS r_squared, avg(excess) / stddev_samp(excess) * sqrt(252) AS information_ratio FROM al GROUP BY 1", "beta r_squared information_ratio")
def bkd_regression(spark, d):
    return indicators.regression(comparative.aligned_returns(bars(spark, d), benchmark(spark, d)))


_RECENT = f"""{RETURNS}, k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) <= 60),
    x AS (SELECT *, CASE WHEN count(*) {over(30)} = 30 THEN stddev_samp(r) {over(30)} END AS rolling, stddev_samp(r) OVER (PARTITION BY instrument_id) AS daily FROM k),
    v AS (SELECT instrument_id, count(*) AS n, max(daily) AS daily_volatility, max(daily) * sqrt(252) AS annualised_volatility, avg(CASE WHEN rolling IS NOT NULL THEN (rolling <= daily)::INT END) * 100 AS percentile FROM x GROUP BY 1 HAVING count(*) >= 2)"""


@query("exp_03_recent_volatility", f"{_RECENT} SELECT * FROM v", "daily_volatility annualised_volatility percentile")
def exp_03(spark, d):
    return indicators.recent_volatility(bars(spark, d))


@query("exp_04_position_limit", f"""{_RECENT}, z AS (SELECT instrument_id, annualised_volatility AS v, (instrument_id % 10) / 10.0::DOUBLE AS c FROM v),
    l AS (SELECT instrument_id, CASE WHEN v < 0.15 THEN 0.25 WHEN v < 0.3 THEN 0.2 * (1 - (v - 0.15) * 0.5) WHEN v < 0.5 THEN 0.2 * (0.75 - (v - 0.3) * 0.5) ELSE 0.1 END::DOUBLE AS volatility_limit,
      CASE WHEN c >= 0.8 THEN 0.7 WHEN c >= 0.6 THEN 0.85 WHEN c >= 0.4 THEN 1.0 WHEN c >= 0.2 THEN 1.05 ELSE 1.1 END::DOUBLE AS correlation_multiplier FROM z)
    SELECT *, volatility_limit * correlation_multiplier AS "limit", volatility_limit * correlation_multiplier / 0.2::DOUBLE - 1 AS against_base FROM l""", "volatility_limit correlation_multiplier limit against_base".replace(" limit ", ' "limit" '))
def exp_04(spark, d):
    v = indicators.recent_volatility(bars(spark, d))
    return indicators.position_limit(v, v.select("instrument_id", (F.col("instrument_id") % 10 / 10.0).alias("mean_correlation")))


@query("exp_06_nearest_vectors", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM e),
    p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.l * v.l), 9) AS similarity FROM n q JOIN n v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 3""", "similarity")
def exp_06(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return indicators.nearest(e.where("vec_id % 100 = 0"), e)


# ---- selection ----

_SECTIONS = [context.Section("activity", ("act",), ("summary", "observation")), context.Section("prices", (), ("series",), max_points=30), context.Section("rest")]
_ITEMS = """it AS (SELECT user_id AS instrument_id, 'i' || event_id % 40 AS item_id, CASE event_id % 40 % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'observation' ELSE 'series' END AS kind,
  CASE WHEN event_id % 40 % 2 = 0 THEN 'activity.n' ELSE 'other' END AS metric, count(*) * 7 AS points FROM events GROUP BY 1, 2, 3, 4)"""


def all_items(spark, d):
    """Items over all events: the kind comes from the item's number, so that each item has one."""
    e, k = read(spark, d, "events"), F.col("event_id") % 40
    kind = F.when(k % 3 == 0, "summary").when(k % 3 == 1, "observation").otherwise("series")
    return e.groupBy(
        F.col("user_id").alias("instrument_id"), F.concat(F.lit("i"), k.cast("string")).alias("item_id"), F.when(k % 2 == 0, "activity.n").otherwise("other").alias("metric"), kind.alias("kind")
    ).agg((F.count(F.lit(1)) * 7).alias("points"))


_SELECTED = f"""WITH {_ITEMS}, p AS (SELECT *, CASE WHEN kind <> 'series' AND metric LIKE 'act%' THEN 0 WHEN kind = 'series' THEN 1 ELSE 2 END AS place,
      CASE kind WHEN 'summary' THEN 1 WHEN 'observation' THEN 2 ELSE 3 END AS k, CASE WHEN kind = 'series' THEN least(points, 30) ELSE 0 END AS wanted FROM it),
    u AS (SELECT *, coalesce(sum(wanted) OVER (PARTITION BY instrument_id ORDER BY place, k, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p),
    s AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY place, k, item_id) AS position FROM u WHERE kind <> 'series' OR used < 60)"""


@query("ctx_01_select_items", f"""{_SELECTED} SELECT instrument_id, item_id, kind, metric, CASE place WHEN 0 THEN 'activity' WHEN 1 THEN 'prices' ELSE 'rest' END AS section, position,
    CASE WHEN kind = 'series' THEN least(wanted, 60 - used)::BIGINT END AS included_points, CASE WHEN kind = 'series' THEN (wanted - least(wanted, 60 - used))::BIGINT END AS omitted_points FROM s WHERE position <= 12""")
def ctx_01(spark, d):
    return context.select_items(all_items(spark, d), _SECTIONS, max_items=12, max_points=60)


@query("rpr_03_pack_text", f"""{_SELECTED} SELECT instrument_id, string_agg('- ' || CASE place WHEN 0 THEN 'activity' WHEN 1 THEN 'prices' ELSE 'rest' END || ' / ' || metric
    || coalesce(CASE WHEN kind = 'series' THEN ' (' || least(wanted, 60 - used)::BIGINT || ' points)' END, ''), chr(10) ORDER BY position) AS text FROM s WHERE position <= 12 GROUP BY 1""")
def rpr_03(spark, d):
    return context.pack_text(context.select_items(all_items(spark, d), _SECTIONS, max_items=12, max_points=60))


@query("ctx_01_select_all_items", f"""{_SELECTED} SELECT instrument_id, item_id, kind, metric, CASE place WHEN 0 THEN 'activity' WHEN 1 THEN 'prices' ELSE 'rest' END AS section, position,
    CASE WHEN kind = 'series' THEN least(wanted, 60 - used)::BIGINT END AS included_points, CASE WHEN kind = 'series' THEN (wanted - least(wanted, 60 - used))::BIGINT END AS omitted_points FROM s WHERE position <= 12""")
def ctx_01_all(spark, d):
    return context.select_items(all_items(spark, d), _SECTIONS, max_items=12, max_points=60)


@query("rpr_03_pack_all_text", f"""{_SELECTED} SELECT instrument_id, string_agg('- ' || CASE place WHEN 0 THEN 'activity' WHEN 1 THEN 'prices' ELSE 'rest' END || ' / ' || metric
    || coalesce(CASE WHEN kind = 'series' THEN ' (' || least(wanted, 60 - used)::BIGINT || ' points)' END, ''), chr(10) ORDER BY position) AS text FROM s WHERE position <= 12 GROUP BY 1""")
def rpr_03_all(spark, d):
    return context.pack_text(context.select_items(all_items(spark, d), _SECTIONS, max_items=12, max_points=60))


@query("rpr_02_markdown_lines", "SELECT '| ' || s_suppkey || ' | ' || replace(s_name, '|', '\\|') || ' |' AS line FROM supplier")
def rpr_02(spark, d):
    return context.lines(read(spark, d, "supplier").select("s_suppkey", "s_name"))[1]
