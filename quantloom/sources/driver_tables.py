"""Domain tables from the driver's star-schema tables: price bars, benchmark, peers, statements, holdings, deals, events.

The tables are proxies; the operators are what is computed. Every view is one aggregation or projection, so filters
and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price bars: an instrument is a supplier, a price is extended price per unit on a ship day."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("instrument_id"), F.col("l_shipdate").cast("timestamp").alias("ts"))
        .agg(
            F.min_by(price, key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, key).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("traded_value"),
            (F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0)) * 100 / F.sum("l_quantity")).alias("delivery_percent"),
        )
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One close a day over all instruments."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("timestamp").alias("ts"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("benchmark_close"))
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument_id, peer_id): suppliers of one nation."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = s.select(F.col("s_suppkey").alias("peer_id"), F.col("s_nationkey").alias("n"))
    return s.join(p, F.col("s_nationkey") == F.col("n")).where("s_suppkey <> peer_id").select(F.col("s_suppkey").alias("instrument_id"), "peer_id")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements: sums over the lines that a supplier shipped in a quarter."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    quarter = F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp"))
    flag = lambda f, x: F.sum(F.when(F.col("l_returnflag") == f, x).otherwise(F.lit(0.0)))
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("instrument_id"), quarter.alias("q"))
        .agg(
            F.sum(net).alias("revenue"),
            flag("N", net).alias("gross_profit"),
            flag("A", net).alias("ebitda"),
            (flag("A", net) * 0.8).alias("ebit"),
            (flag("A", net) * 0.6).alias("net_income"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("interest_expense"),
            F.sum("l_extendedprice").alias("total_assets"),
            (F.sum("l_extendedprice") * 0.4).alias("total_equity"),
            flag("R", F.col("l_extendedprice")).alias("total_debt"),
            (F.sum(F.col("l_quantity")) * 10).alias("cash"),
            flag("N", F.col("l_extendedprice")).alias("current_assets"),
            flag("R", F.col("l_extendedprice") * F.col("l_tax")).alias("inventory"),
            flag("A", F.col("l_extendedprice") * 0.5).alias("current_liabilities"),
            F.sum(net * F.col("l_tax")).alias("operating_cash_flow"),
            (-F.sum(net * F.col("l_tax") * F.col("l_discount"))).alias("capital_expenditure"),
        )
        .withColumn("period_end", F.last_day(F.add_months("q", 2)))
        .withColumn("period_type", F.lit("quarterly"))
        .drop("q")
    )


def shareholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holder classes: shares of order value by market segment, for each customer nation and quarter."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("q"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    names = {"AUTOMOBILE": "promoter", "BUILDING": "public", "FURNITURE": "fii", "HOUSEHOLD": "dii", "MACHINERY": "government"}
    part = lambda s: F.sum(F.when(F.col("c_mktsegment") == s, F.col("o_totalprice")))
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("instrument_id"), "q")
        .agg(*((part(s) * 100 / F.sum("o_totalprice")).alias(n) for s, n in names.items()))
        .withColumn("period_end", F.last_day(F.add_months("q", 2)))
        .drop("q")
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals and insider transactions: lines, the side by return flag, the client by order."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("instrument_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_orderkey") % 97).alias("client"),
        F.col("l_linestatus").alias("deal_type"),
    )


def company_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("instrument_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        "event_id",
        "event_type",
        "value",
        "props",
    )


#: The same views for DuckDB, as common table expressions.
BARS_SQL = """bars AS (
  SELECT l_suppkey AS instrument_id, l_shipdate AS ts,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS traded_value,
         100 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS delivery_percent
  FROM lineitem GROUP BY 1, 2
)"""
BENCHMARK_SQL = """bench AS (
  SELECT l_shipdate AS ts, sum(l_extendedprice) / sum(l_quantity) AS benchmark_close FROM lineitem GROUP BY 1
)"""
STATEMENTS_SQL = """statements AS (
  SELECT l_suppkey AS instrument_id, last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE AS period_end,
         'quarterly' AS period_type,
         sum(l_extendedprice * (1 - l_discount)) AS revenue,
         sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS gross_profit,
         sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS ebitda,
         sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) * 0.8::DOUBLE AS ebit,
         sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) * 0.6::DOUBLE AS net_income,
         sum(l_extendedprice * l_discount) AS interest_expense,
         sum(l_extendedprice) AS total_assets, sum(l_extendedprice) * 0.4::DOUBLE AS total_equity,
         sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS total_debt,
         sum(l_quantity) * 10 AS cash,
         sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS current_assets,
         sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax ELSE 0 END) AS inventory,
         sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * 0.5::DOUBLE ELSE 0 END) AS current_liabilities,
         sum(l_extendedprice * (1 - l_discount) * l_tax) AS operating_cash_flow,
         -sum(l_extendedprice * (1 - l_discount) * l_tax * l_discount) AS capital_expenditure
  FROM lineitem GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)
)"""
SHAREHOLDING_SQL = """holdings AS (
  SELECT c_nationkey AS instrument_id, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE AS period_end,
         100 * sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN o_totalprice END) / sum(o_totalprice) AS promoter,
         100 * sum(CASE WHEN c_mktsegment = 'BUILDING' THEN o_totalprice END) / sum(o_totalprice) AS public,
         100 * sum(CASE WHEN c_mktsegment = 'FURNITURE' THEN o_totalprice END) / sum(o_totalprice) AS fii,
         100 * sum(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN o_totalprice END) / sum(o_totalprice) AS dii,
         100 * sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN o_totalprice END) / sum(o_totalprice) AS government
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, date_trunc('quarter', o_orderdate)
)"""
DEALS_SQL = """deals AS (
  SELECT l_suppkey AS instrument_id, l_shipdate AS event_time, CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side,
         l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS value,
         l_orderkey % 97 AS client, l_linestatus AS deal_type FROM lineitem
)"""
