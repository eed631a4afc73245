"""Queries of the record, identity, temporal, reconciliation, quality, canonical, graph and timeline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import canonical, graph, identity, quality, reconcile, records, temporal
from quantloom.plans.catalog import query
from quantloom.sources.driver_tables import BARS_SQL, bars, read

# ---- views, for Spark and for DuckDB ----


def versions(spark, d):
    """Event records by user and day, some several times; ``_seq`` is the order in which they came."""
    return read(spark, d, "events").select(
        F.col("user_id").alias("instrument_id"), F.col("ts").cast("date").alias("day"), "event_type", "value", F.col("event_id").alias("_seq")
    )


VERSIONS = "v AS (SELECT user_id AS instrument_id, ts::DATE AS day, event_type, value, event_id AS _seq FROM events)"


def stamped(spark, d):
    """Event records with what is known of their times: a third each published, observed, and only retrieved."""
    e = read(spark, d, "events")
    k = F.col("event_id") % 3
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("record_id"), F.col("event_type").alias("record_type"), F.col("user_id").alias("instrument_id"), ts.alias("timestamp"),
        F.when(k == 0, ts + F.expr("make_dt_interval(cast(event_id % 5 as int))")).alias("published_at"),
        F.when(k == 1, ts + F.expr("make_dt_interval(0, 1)")).alias("observed_at"),
        (ts + F.expr("make_dt_interval(0, cast(event_id % 3 as int))")).alias("retrieved_at"),
        "value", "props", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"),
    )


STAMPED = """st AS (SELECT event_id AS record_id, event_type AS record_type, user_id AS instrument_id, ts AS timestamp,
  CASE WHEN event_id % 3 = 0 THEN ts + to_days((event_id % 5)::INTEGER) END AS published_at,
  CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 1 HOUR END AS observed_at, ts + to_hours((event_id % 3)::INTEGER) AS retrieved_at,
  value, props, 's' || (event_id % 4)::VARCHAR AS source FROM events),
env AS (SELECT *, timestamp AS event_time, coalesce(published_at, observed_at, retrieved_at) AS available_at,
  CASE WHEN published_at IS NOT NULL THEN 'published' WHEN observed_at IS NOT NULL THEN 'observed' ELSE 'retrieved' END AS basis FROM st)"""
AS_OF_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def as_of():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def priced_twice(spark, d):
    """Two sources for each supplier-day's price, one of them only on even days of the month."""
    g = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity_key"), F.col("l_shipdate").cast("timestamp").alias("observed_at"))
    g = g.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("a"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("b"))
    b = F.when(F.dayofmonth("observed_at") % 2 == 0, F.col("b"))
    rows = g.select("entity_key", "observed_at", F.lit("close").alias("field"), F.inline(F.array(F.struct(F.lit("weighted").alias("source"), F.col("a").alias("value")), F.struct(F.lit("plain").alias("source"), b.alias("value")))))
    return rows.where("value IS NOT NULL").withColumn("observation_id", F.concat_ws("/", "entity_key", F.date_format("observed_at", "yyyy-MM-dd"), "source"))


PRICED = """g AS (SELECT l_suppkey::VARCHAR AS entity_key, l_shipdate AS observed_at, sum(l_extendedprice) / sum(l_quantity) AS a,
  avg(l_extendedprice / l_quantity) AS b FROM lineitem GROUP BY 1, 2),
o AS (SELECT entity_key, observed_at, 'close' AS field, source, value, entity_key || '/' || strftime(observed_at, '%Y-%m-%d') || '/' || source AS observation_id
  FROM (SELECT entity_key, observed_at, 'weighted' AS source, a AS value FROM g UNION ALL
        SELECT entity_key, observed_at, 'plain', b FROM g WHERE day(observed_at) % 2 = 0))"""


def status_sql(keys: str) -> str:
    return f"""r AS (SELECT {keys}, count(value) AS n, max(value) - min(value) AS spread,
      CASE WHEN max(abs(value)) = 0 THEN 0 ELSE (max(value) - min(value)) / max(abs(value)) END AS relative,
      CASE WHEN bool_or(source = 'plain') THEN '' ELSE 'plain' END AS missing_sources FROM o GROUP BY {keys}),
    s AS (SELECT {keys}, n, spread, relative, CASE WHEN n < 2 THEN CASE WHEN missing_sources <> '' THEN 'missing' ELSE 'unresolvable' END
      WHEN spread <= 0 OR relative <= 1e-4 THEN CASE WHEN missing_sources <> '' THEN 'missing' ELSE 'agree' END
      WHEN relative <= 1e-3 THEN 'minor_difference' ELSE 'conflicting' END AS status, missing_sources FROM r)"""


def names(spark, d):
    """Names of suppliers: their own, a token, and their nation's, which most share."""
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("instrument_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("in"), F.col("s_suppkey").cast("string"))).alias("isin"),
        F.concat(F.lit(" "), F.col("s_name")).alias("symbol"), F.col("n_name").alias("name"), F.concat(F.lit("tok"), F.col("s_suppkey").cast("string")).alias("exchange_token"),
    )
    return rows


NAMES = """na AS (SELECT s_suppkey::VARCHAR AS instrument_id, CASE WHEN s_suppkey % 3 = 0 THEN 'in' || s_suppkey::VARCHAR END AS isin,
  ' ' || s_name AS symbol, n_name AS name, 'tok' || s_suppkey::VARCHAR AS exchange_token FROM supplier JOIN nation ON s_nationkey = n_nationkey),
al AS (SELECT DISTINCT instrument_id, alias_type, value, upper(trim(value)) AS norm FROM (
  SELECT instrument_id, 'isin' AS alias_type, isin AS value FROM na UNION ALL SELECT instrument_id, 'symbol', symbol FROM na UNION ALL
  SELECT instrument_id, 'name', name FROM na UNION ALL SELECT instrument_id, 'exchange_token', exchange_token FROM na) WHERE trim(value) <> ''),
ix AS (SELECT alias_type, norm, min(instrument_id) AS instrument_id FROM al GROUP BY 1, 2 HAVING count(DISTINCT instrument_id) = 1)"""

# ---- records ----

for _name, _keys, _which in (
    ("ded_01_last_by_source", ("instrument_id", "day", "event_type"), "last"),
    ("ded_01b_last_of_all_sources", ("instrument_id", "day"), "last"),
    ("ded_02_last_by_instrument", ("instrument_id",), "last"),
    ("ded_11_first_by_key", ("instrument_id", "event_type"), "first"),
):

    @query(
        _name,
        f"""WITH {VERSIONS} SELECT instrument_id, day, event_type, value, _seq AS seq FROM v
        QUALIFY row_number() OVER (PARTITION BY {", ".join(_keys)} ORDER BY _seq {"DESC" if _which == "last" else "ASC"}) = 1""",
        "value",
    )
    def _deduplicated(spark, d, keys=_keys, which=_which):
        return records.one_of_each(versions(spark, d), keys, F.col("_seq"), which).withColumnRenamed("_seq", "seq")


@query("grp_01_records_by_group", f"WITH {VERSIONS} SELECT event_type, count(*) AS n, min(_seq) AS first_id, max(_seq) AS last_id FROM v GROUP BY 1")
def grp_01(spark, d):
    return records.grouped(versions(spark, d), "event_type", "_seq")


@query("flt_01_titles_containing", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt')")
def flt_01(spark, d):
    return records.titles_containing(read(spark, d, "part"), "BOLT", "p_name").select("p_partkey", "p_name")


_DAMAGED = """b AS (SELECT instrument_id, ts, CASE WHEN day(ts) = 1 THEN -open ELSE open END AS open, CASE WHEN day(ts) = 2 THEN low / 2 ELSE high END AS high,
  low, CASE WHEN day(ts) = 3 THEN high * 2 ELSE close END AS close, CASE WHEN day(ts) = 4 THEN -volume ELSE volume END AS volume,
  CASE WHEN day(ts) = 5 THEN 101.0::DOUBLE ELSE delivery_percent END AS delivery_percent FROM bars)"""
_RULES = {
    "non_positive_price": "least(open, high, low, close) <= 0", "high_below_low": "high < low", "open_above_high": "open > high", "open_below_low": "open < low",
    "close_above_high": "close > high", "close_below_low": "close < low", "negative_volume": "volume < 0", "delivery_out_of_range": "NOT delivery_percent BETWEEN 0 AND 100",
}


@query("val_01_price_bars", f"WITH {BARS_SQL}, {_DAMAGED} " + " UNION ALL ".join(f"SELECT instrument_id, ts, '{n}' AS rule FROM b WHERE {c}" for n, c in _RULES.items()))
def val_01(spark, d):
    day = F.dayofmonth("ts")
    damaged = bars(spark, d).withColumns({
        "open": F.when(day == 1, -F.col("open")).otherwise(F.col("open")),
        "high": F.when(day == 2, F.col("low") / 2).otherwise(F.col("high")),
        "close": F.when(day == 3, F.col("high") * 2).otherwise(F.col("close")),
        "volume": F.when(day == 4, -F.col("volume")).otherwise(F.col("volume")),
        "delivery_percent": F.when(day == 5, 101.0).otherwise(F.col("delivery_percent")),
    })
    return records.validated_bars(damaged, "instrument_id", "ts")


@query(
    "rcn_01_price_conflicts",
    f"""WITH {PRICED}, c AS (SELECT entity_key, observed_at, count(*) AS n, max(value) - min(value) AS spread, max(abs(value)) AS m FROM o GROUP BY 1, 2)
    SELECT entity_key, observed_at, n, spread, spread / m AS relative FROM c WHERE n >= 2 AND spread / nullif(m, 0) > 1e-4""",
    "spread relative",
)
def rcn_01(spark, d):
    return records.price_conflicts(priced_twice(spark, d).withColumnRenamed("value", "close"), ("entity_key", "observed_at"))


# ---- reconciliation ----

for _name, _keys in (("rcn_03_by_entity", ("entity_key", "field")), ("rcn_03_by_day", ("entity_key", "field", "observed_at"))):

    @query(_name, f"WITH {PRICED}, {status_sql(', '.join(_keys))} SELECT * FROM s", "spread relative")
    def _status(spark, d, keys=_keys):
        return reconcile.reconciled(priced_twice(spark, d), keys, expected=("weighted", "plain"))


@query(
    "rcn_05_with_decisions",
    f"""WITH {PRICED}, {status_sql("entity_key, field, observed_at")}
    SELECT s.entity_key, s.field, s.observed_at, s.status, o.observation_id, o.source, o.value FROM s JOIN o USING (entity_key, field, observed_at)
    WHERE s.status IN ('agree', 'minor_difference')
    QUALIFY row_number() OVER (PARTITION BY s.entity_key, s.field, s.observed_at ORDER BY CASE WHEN o.source = 'plain' THEN 0 ELSE 1 END, o.source) = 1""",
    "value",
)
def rcn_05(spark, d):
    keys, o = ("entity_key", "field", "observed_at"), priced_twice(spark, d)
    return reconcile.chosen(o, reconcile.reconciled(o, keys, expected=("weighted", "plain")), keys, priority=("plain",))


# ---- identity ----


@query("idn_01_aliases", f"WITH {NAMES} SELECT instrument_id, alias_type, norm, value FROM al")
def idn_01(spark, d):
    return identity.aliases(names(spark, d))


@query("idn_03_alias_index", f"WITH {NAMES} SELECT alias_type, norm, instrument_id FROM ix")
def idn_03(spark, d):
    return identity.alias_index(identity.aliases(names(spark, d)))


@query("idn_06_company_aliases", f"WITH {NAMES} SELECT instrument_id, alias_type, norm, value FROM al WHERE alias_type NOT IN ('instrument_key', 'exchange_token')")
def idn_06(spark, d):
    return identity.company_view(identity.aliases(names(spark, d)))


@query("idn_02_merged", """SELECT instrument_id, arg_max({'s': source}, k).s AS source, arg_max({'v': value}, k).v AS value FROM (
  SELECT user_id AS instrument_id, event_type AS source, CASE WHEN event_id % 3 > 0 THEN event_type END AS value,
    (ts, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 1 END, event_type) AS k FROM events) GROUP BY 1""")
def idn_02(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("instrument_id"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("value"), F.col("ts").alias("observed_at"))
    return identity.merged(rows, ("source", "value")).select("instrument_id", "source", "value")


@query(
    "idn_04_resolve",
    f"""WITH {NAMES}, q AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'IN' || (o_orderkey % 20)::VARCHAR END AS isin,
      'supplier#00000000' || (o_orderkey % 10)::VARCHAR AS symbol FROM orders),
    h AS (SELECT request_id, 1 AS k, 'isin' AS t, upper(isin) AS norm FROM q UNION ALL SELECT request_id, 4, 'symbol', upper(symbol) FROM q),
    m AS (SELECT request_id, arg_min(instrument_id, k) AS instrument_id, arg_min(t, k) AS matched_by FROM h JOIN ix ON alias_type = t AND ix.norm = h.norm GROUP BY 1)
    SELECT q.request_id, instrument_id, matched_by FROM q LEFT JOIN m ON m.request_id = q.request_id""",
)
def idn_04(spark, d):
    k = F.col("o_orderkey")
    q = read(spark, d, "orders").select(k.alias("request_id"), F.when(k % 2 == 0, F.concat(F.lit("in"), (k % 20).cast("string"))).alias("isin"), F.concat(F.lit("supplier#00000000"), (k % 10).cast("string")).alias("symbol"))
    return identity.resolved(q, identity.aliases(names(spark, d)))


@query(
    "idn_05_resolve_as_of",
    """WITH a AS (SELECT upper(n_name) AS norm, s_suppkey::VARCHAR AS instrument_id, DATE '1995-01-01' + (s_suppkey % 50 * 40)::INTEGER AS valid_from FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    q AS (SELECT o_orderkey AS request_id, upper(n_name) AS norm, o_orderdate::DATE AS as_of FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    h AS (SELECT request_id, count(DISTINCT instrument_id) AS n, min(instrument_id) AS one FROM q JOIN a ON a.norm = q.norm AND as_of BETWEEN valid_from AND valid_from + 300 GROUP BY 1)
    SELECT q.request_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN one END AS instrument_id
    FROM q LEFT JOIN h ON h.request_id = q.request_id""",
)
def idn_05(spark, d):
    n = read(spark, d, "nation")
    s = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 50 * 40).cast("int"))
    a = s.select(identity.normal(F.col("n_name")).alias("norm"), F.col("s_suppkey").cast("string").alias("instrument_id"), start.alias("valid_from"), F.date_add(start, 300).alias("valid_to"))
    q = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return identity.resolved_at(q.select(F.col("o_orderkey").alias("request_id"), F.col("n_name").alias("name"), F.col("o_orderdate").cast("date").alias("as_of")), a)


# ---- time ----


@query("tmp_01_envelope", f"WITH {STAMPED} SELECT record_id, event_time, available_at, basis, 'instant' AS precision FROM env")
def tmp_01(spark, d):
    return temporal.with_envelope(stamped(spark, d)).select("record_id", "event_time", "available_at", "basis", "precision")


@query("tmp_02_conservative_dates", "SELECT o_orderkey AS record_id, o_orderdate::DATE + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS available_at, 'date' AS precision FROM orders")
def tmp_02(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").cast("date").alias("published_at"))
    return temporal.with_envelope(o).select("record_id", "available_at", "precision")


for _name, _strict in (("tmp_03_visible_strict", True), ("tmp_03_visible_all", False)):

    @query(_name, f"WITH {STAMPED} SELECT record_id FROM env WHERE available_at <= {AS_OF_SQL}" + (" AND basis <> 'retrieved'" if _strict else ""))
    def _visible(spark, d, strict=_strict):
        return temporal.point_in_time(temporal.with_envelope(stamped(spark, d)), as_of(), strict=strict).select("record_id")


@query("tmp_04_point_in_time", f"WITH {STAMPED} SELECT record_id, record_type FROM env WHERE instrument_id = 7 AND available_at <= {AS_OF_SQL} AND basis <> 'retrieved'")
def tmp_04(spark, d):
    return temporal.point_in_time(temporal.with_envelope(stamped(spark, d)), as_of(), instrument=7).select("record_id", "record_type")


@query(
    "tmp_05_what_was_known",
    f"""WITH {STAMPED} SELECT instrument_id, record_id, record_type, row_number() OVER (PARTITION BY instrument_id
      ORDER BY event_time NULLS LAST, available_at NULLS LAST, record_type, record_id) AS position FROM env WHERE available_at <= {AS_OF_SQL} AND basis <> 'retrieved'""",
)
def tmp_05(spark, d):
    return temporal.what_was_known(temporal.with_envelope(stamped(spark, d)), as_of()).select("instrument_id", "record_id", "record_type", "position")


@query("tmp_06_events_between", f"WITH {STAMPED} SELECT record_id, record_type, event_time FROM env WHERE event_time BETWEEN TIMESTAMP '2024-01-10' AND {AS_OF_SQL} AND record_type IN ('error', 'purchase') AND available_at <= {AS_OF_SQL}")
def tmp_06(spark, d):
    found = temporal.events_between(temporal.with_envelope(stamped(spark, d)), F.lit("2024-01-10").cast("timestamp"), as_of(), ("error", "purchase"), known_by_end=True)
    return found.select("record_id", "record_type", "event_time")


_KIND = "CASE record_type WHEN 'view' THEN 'filing' WHEN 'click' THEN 'company_document' ELSE record_type END"


@query("tmp_07_documents_available", f"WITH {STAMPED} SELECT record_id, {_KIND} AS record_type FROM env WHERE {_KIND} IN ('filing', 'company_document') AND available_at <= {AS_OF_SQL} AND basis <> 'retrieved'")
def tmp_07(spark, d):
    kind = F.when(F.col("record_type") == "view", "filing").when(F.col("record_type") == "click", "company_document").otherwise(F.col("record_type"))
    return temporal.documents_available(temporal.with_envelope(stamped(spark, d).withColumn("record_type", kind)), as_of()).select("record_id", "record_type")


@query("tmp_08_by_instrument", "SELECT event_id AS record_id, user_id AS instrument_id FROM events UNION SELECT event_id, user_id % 10 FROM events UNION SELECT event_id, 3 FROM events WHERE event_id % 2 = 0")
def tmp_08(spark, d):
    many = F.when(F.col("event_id") % 2 == 0, F.array(F.col("user_id") % 10, F.lit(3).cast("long"))).otherwise(F.array(F.col("user_id") % 10))
    e = read(spark, d, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("instrument_id"), many.alias("instrument_ids"))
    return temporal.by_instrument(e).select("record_id", "instrument_id")


@query(
    "tmp_09_known_counts",
    f"""WITH {STAMPED}, t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 7 DAYS)) AS as_of),
    f AS (SELECT instrument_id, min(as_of) AS first_seen FROM (SELECT record_id, instrument_id, min(as_of) AS as_of FROM env JOIN t ON as_of >= available_at WHERE basis <> 'retrieved' GROUP BY 1, 2) GROUP BY 1)
    SELECT f.instrument_id, t.as_of, count(e.record_id) AS known FROM f CROSS JOIN t
    LEFT JOIN env e ON e.instrument_id = f.instrument_id AND e.available_at <= t.as_of AND e.basis <> 'retrieved' GROUP BY 1, 2""",
)
def tmp_09(spark, d):
    return temporal.known_counts(temporal.with_envelope(stamped(spark, d)), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-05").cast("timestamp"))


# ---- quality ----


@query("dq_01_presence", f"WITH {STAMPED} " + " UNION ALL ".join(f"SELECT '{c}' AS field, '{s}' AS status, {n} AS n FROM st" for c in ("published_at", "observed_at") for s, n in (("present", f"count({c})"), ("unknown", f"count(*) - count({c})"))))
def dq_01(spark, d):
    return quality.presence(stamped(spark, d), ("published_at", "observed_at"))


@query("dq_02_missing_fields", f"""WITH {STAMPED} SELECT 'missing' AS category, 'warning' AS severity, record_id::VARCHAR AS subject, 'published_at' AS detail FROM st WHERE record_type = 'error' AND published_at IS NULL
    UNION ALL SELECT 'missing', 'warning', record_id::VARCHAR, 'observed_at' FROM st WHERE record_type = 'view' AND observed_at IS NULL""")
def dq_02(spark, d):
    return quality.missing_fields(stamped(spark, d), "record_id", {"error": ("published_at",), "view": ("observed_at",)})


@query("dq_03_stale_sources", f"""WITH {STAMPED} SELECT 'stale' AS category, 'warning' AS severity, record_id::VARCHAR AS subject, source AS detail FROM st
    WHERE epoch_us({AS_OF_SQL}) // 1000000 - epoch_us(coalesce(observed_at, published_at, retrieved_at)) // 1000000 > 86400 * CASE source WHEN 's0' THEN 5 WHEN 's1' THEN 10 END + 1""")
def dq_03(spark, d):
    return quality.stale_sources(stamped(spark, d), as_of(), {"s0": 5, "s1": 10}, "record_id")


@query("dq_04_reconciliation_findings", f"""WITH {PRICED}, {status_sql("entity_key, field, observed_at")} SELECT 'reconciliation' AS category,
    CASE WHEN status = 'conflicting' THEN 'error' ELSE 'warning' END AS severity, entity_key || '|' || field AS subject, status AS detail FROM s WHERE status IN ('conflicting', 'missing', 'unresolvable')""")
def dq_04(spark, d):
    return quality.of_reconciliation(reconcile.reconciled(priced_twice(spark, d), ("entity_key", "field", "observed_at"), expected=("weighted", "plain")), "entity_key", "field")


@query("dq_05_duplicates", f"WITH {VERSIONS} SELECT 'duplicate' AS category, 'warning' AS severity, min(_seq)::VARCHAR AS subject, count(*)::VARCHAR AS detail FROM v GROUP BY instrument_id, day, event_type HAVING count(*) > 1")
def dq_05(spark, d):
    return quality.duplicates(versions(spark, d), ("instrument_id", "day", "event_type"), "_seq")


@query("dq_06_timestamp_anomalies", f"""WITH {STAMPED} SELECT 'timestamp' AS category, 'error' AS severity, record_id::VARCHAR AS subject, 'published_at_after_retrieved_at' AS detail FROM st WHERE published_at > retrieved_at
    UNION ALL SELECT 'timestamp', 'error', record_id::VARCHAR, 'observed_at_after_retrieved_at' FROM st WHERE observed_at > retrieved_at""")
def dq_06(spark, d):
    return quality.timestamp_anomalies(stamped(spark, d), "record_id")


_SIGNED = "sg AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN 'extra:string,k:number' ELSE 'k:number' END AS signature FROM events)"


@query("dq_07_schema_signature", f"WITH {_SIGNED} SELECT event_id, signature FROM sg")
def dq_07(spark, d):
    return signed(spark, d).select("event_id", "signature")


def signed(spark, d):
    text = F.when(F.col("event_id") % 50 == 7, F.regexp_replace("props", r"\}", ', "extra": "x"}')).otherwise(F.col("props"))
    return read(spark, d, "events").withColumn("signature", quality.json_signature(text))


@query("dq_08_schema_drift", f"""WITH {_SIGNED}, f AS (SELECT event_type, arg_min(signature, event_id) AS first FROM sg GROUP BY 1)
    SELECT 'schema_drift' AS category, 'warning' AS severity, event_id::VARCHAR AS subject, CASE WHEN signature = 'k:number' THEN '+ -extra:string' ELSE '+extra:string -' END AS detail
    FROM sg JOIN f ON f.event_type = sg.event_type WHERE signature <> first""")
def dq_08(spark, d):
    return quality.schema_drift(signed(spark, d), ("event_type",), "signature", "event_id", "event_id")


@query("dq_09_identity_ambiguity", f"WITH {NAMES} SELECT 'identity' AS category, 'error' AS severity, alias_type || ':' || norm AS subject, count(DISTINCT instrument_id)::VARCHAR AS detail FROM al GROUP BY alias_type, norm HAVING count(DISTINCT instrument_id) > 1")
def dq_09(spark, d):
    return quality.identity_ambiguity(identity.aliases(names(spark, d)))


@query("dq_10_invalid_numbers", "SELECT 'invalid_number' AS category, 'error' AS severity, event_id::VARCHAR AS subject, 'value' AS detail FROM events WHERE event_id % 100 IN (1, 2)")
def dq_10(spark, d):
    k = F.col("event_id") % 100
    bad = F.when(k == 1, float("nan")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return quality.invalid_numbers(read(spark, d, "events").withColumn("value", bad), "event_id")


@query("dq_11_report", f"""WITH {STAMPED}, {VERSIONS} SELECT 'timestamp' AS category, 'error' AS severity, count(*) AS n, FALSE AS passed FROM st WHERE published_at > retrieved_at OR observed_at > retrieved_at
    UNION ALL SELECT 'duplicate', 'warning', count(*), FALSE FROM (SELECT 1 FROM v GROUP BY instrument_id, day, event_type HAVING count(*) > 1)""")
def dq_11(spark, d):
    return quality.report(quality.timestamp_anomalies(stamped(spark, d), "record_id"), quality.duplicates(versions(spark, d), ("instrument_id", "day", "event_type"), "_seq"))


# ---- canonical records ----


@query("can_01_natural_key", """SELECT event_id, 'typed:company_events|{"event_id":"' || event_id::VARCHAR || '"}' AS natural_key FROM events""")
def can_01(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", canonical.natural_key(e, "company_events").alias("natural_key"))


@query("can_02_record_id", """SELECT event_id, sha256('events|company_events|typed:company_events|{"event_id":"' || event_id::VARCHAR || '"}') AS record_id FROM events""")
def can_02(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", canonical.record_id("events", "company_events", canonical.natural_key(e, "company_events")).alias("record_id"))


@query("can_03_envelope", """SELECT sha256('reference|instruments|typed:instruments|{"instrument_id":"' || s_suppkey::VARCHAR || '"}') AS record_id, 'reference' AS domain, 'instruments' AS record_type,
    'typed:instruments|{"instrument_id":"' || s_suppkey::VARCHAR || '"}' AS natural_key, '{"instrument_id":' || s_suppkey::VARCHAR || ',"symbol":"' || s_name || '"}' AS payload FROM supplier""")
def can_03(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.col("s_name").alias("symbol"))
    return canonical.canonical(s, "reference", "instruments")


_FIELDS = ("open", "high", "low", "close", "volume", "traded_value")


@query("can_04_observations", f"WITH {BARS_SQL} SELECT * REPLACE (sha256(concat_ws('|', entity_key, field, source, strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS observation_id) FROM (" + " UNION ALL ".join(f"SELECT instrument_id::VARCHAR AS entity_key, 'own' AS source, ts, '{c}' AS field, {c} AS value, '' AS observation_id FROM bars WHERE {c} IS NOT NULL" for c in _FIELDS) + ")", "value")
def can_04(spark, d):
    return canonical.observations(bars(spark, d).withColumn("source", F.lit("own")), "price_bars", _FIELDS, ("ts",))


@query("can_07_ingest", "SELECT 'relates_to_instrument' AS predicate, user_id::VARCHAR AS instrument_id, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'relates_to_instrument', 'S' || s_suppkey::VARCHAR, 1 FROM supplier")
def can_07(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("instrument_id"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("instrument_id"), "s_name")
    bundle = canonical.ingested({"company_events": ("events", e), "instruments": ("reference", s)})
    return bundle["edges"].groupBy("predicate", "instrument_id").agg(F.count(F.lit(1)).alias("n"))


@query("chk_01_evidence_chain", """SELECT 'missing_observation' AS problem, 'r' || event_id AS id, 'o' || event_id AS refers_to FROM events WHERE event_id % 20 = 3
    UNION ALL SELECT 'other_record', 'o' || event_id, 'rx' FROM events WHERE event_id % 20 = 4 UNION ALL SELECT 'missing_raw', 'o' || event_id, 'w' || event_id % 100 FROM events WHERE event_id % 20 <> 3 AND event_id % 100 IN (60, 61)""")
def chk_01(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("k"))
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    k = F.col("k")
    held = e.select(name("r", k).alias("record_id"), F.array(name("o", k)).alias("observation_ids"))
    seen = e.where(k % 20 != 3).select(name("o", k).alias("observation_id"), F.when(k % 20 == 4, "rx").otherwise(name("r", k)).alias("canonical_record_id"), name("w", k % 100).alias("raw_ref"))
    raw = spark.range(100).where("id NOT IN (60, 61)").select(name("w", F.col("id")).alias("raw_ref"))
    return canonical.evidence_gaps(held, seen, raw)


# ---- graph and timeline ----


def facts(spark, d):
    line = read(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", F.col("l_linestatus").alias("source"))
    made = graph.edges_from(line, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "ships", F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "l_orderkey")
    based = read(spark, d, "supplier").withColumn("source", F.lit("ref"))
    return made.unionByName(graph.edges_from(based, F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "based_in", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "s_suppkey"))


FACTS = """f AS (SELECT 's' || l_suppkey AS subject, 'ships' AS predicate, 'p' || l_partkey AS object, l_orderkey::VARCHAR AS evidence, l_linestatus AS source FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey, s_suppkey::VARCHAR, 'ref' FROM supplier),
ed AS (SELECT sha256(subject || '|' || predicate || '|' || object) AS edge_id, subject, predicate, object, count(DISTINCT evidence) AS n_evidence, min(evidence) AS first_evidence,
  CASE WHEN min(source) = max(source) THEN min(source) ELSE 'multiple' END AS source FROM f GROUP BY subject, predicate, object)"""


@query("grf_01_edges", f"WITH {FACTS} SELECT * FROM ed")
def grf_01(spark, d):
    return graph.merged_edges(facts(spark, d))


@query("grf_01_nodes", "SELECT 'n' || n_nationkey AS node_id, 'nation' AS kind, n_name AS label FROM nation")
def grf_01_nodes(spark, d):
    n = read(spark, d, "nation")
    node = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    rows = n.select(node.alias("node_id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"))
    bare = read(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node_id"), F.lit("nation").alias("kind"))
    return graph.merged_nodes(rows.unionByName(bare.withColumn("label", F.col("node_id"))))


@query("grf_03_neighbours", f"WITH {FACTS} SELECT DISTINCT subject AS node, object AS neighbour FROM ed WHERE predicate = 'based_in' UNION SELECT object, subject FROM ed WHERE predicate = 'based_in'")
def grf_03(spark, d):
    return graph.neighbours(graph.merged_edges(facts(spark, d)), "based_in")


@query("grf_03_two_hops", f"""WITH {FACTS}, a AS (SELECT subject AS x, object AS y FROM ed UNION SELECT object, subject FROM ed), one AS (SELECT DISTINCT y AS node FROM a WHERE x = 's1'),
    two AS (SELECT DISTINCT a.y AS node FROM a JOIN one ON a.x = one.node WHERE a.y <> 's1' AND a.y NOT IN (SELECT node FROM one))
    SELECT 's1' AS node, 0 AS distance UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""")
def grf_03_hops(spark, d):
    return graph.within_hops(graph.merged_edges(facts(spark, d)), "s1", 2)


@query("tml_01_timeline", f"""WITH {STAMPED} SELECT instrument_id, record_type, event_time, available_at, record_id::VARCHAR AS entry_id, record_type AS title,
    row_number() OVER (PARTITION BY instrument_id ORDER BY event_time NULLS LAST, available_at NULLS LAST, record_type, record_id::VARCHAR) AS position FROM env""")
def tml_01(spark, d):
    return graph.timeline(temporal.with_envelope(stamped(spark, d)))
