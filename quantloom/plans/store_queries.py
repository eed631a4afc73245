"""Queries that write the driver's tables into a folder of their own and read them back: raw files, the incremental store, dated
payloads, files of unknown form, issues of a collection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom.functions.folders import ensure_checkpoint_dir
from quantloom.plans.catalog import query
from quantloom.sources import parsers, sniffed, store
from quantloom.sources.driver_tables import read


def fresh_root(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


_SEGMENT = r"regexp_replace(trim(source), '[^\p{L}\p{N}._-]', '_', 'g')"


@query("snk_01_raw_files", f"""SELECT content_hash, 'raw/' || segment || '/' || substr(content_hash, 1, 2) || '/' || content_hash || '.txt' AS path, n AS size FROM (
    SELECT DISTINCT sha256(text) AS content_hash, {_SEGMENT} AS segment, strlen(text) AS n FROM documents WHERE text IS NOT NULL)""")
def snk_01(spark, d):
    """Each text as a file named by its content, written twice and listed."""
    root = fresh_root(spark)
    docs = read(spark, d, "documents").select("source", F.encode("text", "UTF-8").alias("content"), F.lit("text/plain").alias("media_type"))
    store.write_raw(docs, root)
    store.write_raw(docs, root)
    return store.raw_files(spark, root).select("content_hash", "path", F.octet_length("content").cast("long").alias("size"))


@query("snk_04_read_raw", "SELECT sha256(text) AS content_hash, any_value(md5(text)) AS other_hash, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY 1")
def snk_04(spark, d):
    root = fresh_root(spark)
    store.write_raw(read(spark, d, "documents").select("source", F.encode("text", "UTF-8").alias("content")), root)
    found = store.read_raw(spark, root)
    return found.groupBy("content_hash").agg(F.any_value(F.md5("content")).alias("other_hash"), F.count(F.lit(1)).alias("n_sources"))


@query("snk_02_incremental", """SELECT event_id AS record_id, event_type AS domain, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS batch FROM events""")
def snk_02(spark, d):
    """Three appends, each with what came before it, and the batches made one: every record is there once, as it came first."""
    root = fresh_root(spark)
    e = read(spark, d, "events").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("domain"), "event_id")
    for batch in (1, 2, 3):
        store.append(e.where(F.col("event_id") % 3 < batch).drop("event_id").withColumn("batch_no", F.lit(batch)), root, "canonical")
    store.compact(spark, root, "canonical")
    return store.load(spark, root, "canonical").select("record_id", "domain", F.col("batch_no").alias("batch"))


@query("snk_03_domain", "SELECT event_id AS record_id, user_id FROM events WHERE event_type = 'view'")
def snk_03(spark, d):
    root = fresh_root(spark)
    store.append(read(spark, d, "events").select(F.col("event_id").alias("record_id"), "user_id", F.col("event_type").alias("domain")), root, "canonical")
    return store.load(spark, root, "canonical", "view").drop("domain")


@query("snk_05_dated", "SELECT 's' || event_id % 2 AS source, year(ts) AS year, month(ts) AS month, day(ts) AS day, sha256(event_type) AS content_hash, event_type AS content FROM events GROUP BY ALL")
def snk_05(spark, d):
    """Payloads of a day are there once, however often they come."""
    root = fresh_root(spark)
    rows = read(spark, d, "events").select(F.format_string("s%d", F.col("event_id") % 2).alias("source"), F.col("event_type").alias("content"), F.col("ts").alias("retrieved_at"))
    store.write_dated(rows, root)
    store.write_dated(rows, root)
    found = spark.read.json(f"{root}/landed")
    return found.select("source", F.col("year").cast("long"), F.col("month").cast("long"), F.col("day").cast("long"), "content_hash", "content")


@query("chk_02_layout", "SELECT 'canonical' AS \"table\", 'other_rows' AS problem, (SELECT count(*) FROM events) AS said, (SELECT count(*) FROM events) + (SELECT count(*) FROM nation) AS found")
def chk_02(spark, d):
    """A store whose canonical table has got rows that its manifest doesn't know."""
    root = fresh_root(spark)
    e = read(spark, d, "events")
    records = e.select(F.col("event_id").cast("string").alias("record_id"), F.col("event_type").alias("domain"))
    observed = e.select(F.format_string("o%d", "event_id").alias("observation_id"), F.col("event_id").cast("string").alias("canonical_record_id"), F.lit("value").alias("field"), F.format_string("r%d", F.col("event_id") % 10).alias("raw_ref"))
    store.persist(records, observed, root)
    store.append(read(spark, d, "nation").select(F.format_string("n%d", "n_nationkey").alias("record_id"), F.lit("nation").alias("domain")), root, "canonical")
    said = spark.read.json(f"{root}/manifest").select("table", F.col("rows").alias("said"))
    there = store.counted(spark, root).select("table", F.col("rows").alias("found"))
    return store.layout_problems(spark, root).join(said, "table").join(there, "table")


@query("prs_27_sniffed", "SELECT o_orderkey, 'S' || o_custkey AS symbol, o_orderkey % 2 = 1 AS packed FROM orders")
def prs_27(spark, d):
    """Orders as lines of objects in files without a telling name, half of them compressed."""
    root = fresh_root(spark)
    o = read(spark, d, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", F.format_string("S%d", "o_custkey").alias("symbol"))).alias("value"))
    for packed in (0, 1):
        part = o.where(F.col("o_orderkey") % 2 == packed).select("value")
        part.write.option("compression", "gzip" if packed else "none").text(f"{root}/landed/{'packed' if packed else 'plain'}")
    found = sniffed.read_sniffed(spark, f"{root}/landed")
    return found.where("code IS NULL").select(F.get_json_object("row", "$.o_orderkey").cast("long").alias("o_orderkey"), F.get_json_object("row", "$.symbol").alias("symbol"), F.col("path").contains("/packed/").alias("packed"))


@query("col_15_issues", """SELECT 'upstox' AS source, 'quotes' AS operation, s_suppkey, 'not_a_quote' AS code, 'bad' AS detail FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'upstox', 'candles', s_suppkey, 'short_candle', NULL FROM supplier UNION ALL SELECT 'nse', 'universe', s_suppkey, 'no_symbol', NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def col_15(spark, d):
    """What each source's collection could not use, as one table beside the rows that it could."""
    s = read(spark, d, "supplier")
    quotes = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit('{"data":{"bad":[1],"A":{"ltp":1}}}')).otherwise(F.lit('{"data":{"A":{"ltp":1}}}')).alias("payload"))
    candles = s.select("s_suppkey", F.lit('{"data":{"candles":[["2026-01-01T00:00:00+00:00",1,2,3,4,5],["2026-01-02T00:00:00+00:00",1]]}}').alias("payload"))
    listed = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("symbol"))
    bad = parsers.rejected(listed, F.col("symbol"), "s_suppkey", "no_symbol").select(F.col("record").cast("long").alias("s_suppkey"), "code")
    return parsers.issues(
        ("upstox", "quotes", parsers.not_quotes(quotes, "payload", "s_suppkey").select("s_suppkey", "code", F.col("instrument_key").alias("detail"))),
        ("upstox", "candles", parsers.short_candles(candles, "payload", "s_suppkey")),
        ("nse", "universe", bad),
    )
