"""The graph of facts (nodes, edges with evidence), its neighbourhoods, and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import content_id
from quantloom.functions.folders import ensure_checkpoint_dir
from quantloom.operators.temporal import numbered


def relationship_id(subject: Column, predicate: Column, obj: Column, *validity: Column) -> Column:
    return content_id(subject, predicate, obj, *(v.cast("string") for v in validity))


def edges_from(df: DataFrame, subject: Column, predicate: str, obj: Column, evidence: str, source: str = "source") -> DataFrame:
    rows = df.select(subject.cast("string").alias("subject"), F.lit(predicate).alias("predicate"), obj.cast("string").alias("object"), F.col(evidence).cast("string").alias("evidence"), F.col(source).alias("source"))
    return rows.where("subject IS NOT NULL AND object IS NOT NULL")


def merged_edges(facts: DataFrame) -> DataFrame:
    """One edge for each (subject, predicate, object): how many pieces of evidence it has, the first of them, and its
    source, which is ``multiple`` if there are several. Evidence stays in ``facts``: an edge's may be unbounded."""
    g = facts.groupBy("subject", "predicate", "object").agg(
        F.count_distinct("evidence").alias("n_evidence"), F.min("evidence").alias("first_evidence"), F.min("source").alias("a"), F.max("source").alias("z")
    )
    return g.select(
        relationship_id(F.col("subject"), F.col("predicate"), F.col("object")).alias("edge_id"), "subject", "predicate", "object",
        "n_evidence", "first_evidence", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise("multiple").alias("source"),
    )


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node id: a label that says more than the id wins, then the longest, then the first in order."""
    better = F.struct(F.col("label").isNull() | (F.col("label") == F.col("node_id")), -F.length(F.coalesce("label", F.lit(""))), F.coalesce("label", F.lit("")))
    return nodes.groupBy("node_id", "kind").agg(F.min_by("label", better).alias("label"))


def outgoing(edges: DataFrame, node: str, predicate: str | None = None) -> DataFrame:
    found = edges.where(F.col("subject") == node)
    return found if predicate is None else found.where(F.col("predicate") == predicate)


def incoming(edges: DataFrame, node: str, predicate: str | None = None) -> DataFrame:
    found = edges.where(F.col("object") == node)
    return found if predicate is None else found.where(F.col("predicate") == predicate)


def neighbours(edges: DataFrame, predicate: str | None = None) -> DataFrame:
    """(node, neighbour) in both directions, each once."""
    e = edges if predicate is None else edges.where(F.col("predicate") == predicate)
    return e.select(F.col("subject").alias("node"), F.col("object").alias("neighbour")).unionByName(e.select(F.col("object").alias("node"), F.col("subject").alias("neighbour"))).distinct()


def within_hops(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, distance) of nodes at most ``hops`` edges from ``start``: a join with the frontier for each hop. Edges and every
    frontier are checkpointed, so a hop recomputes none before it."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    around = neighbours(edges).checkpoint()
    found = frontier = spark.createDataFrame([(start, 0)], "node string, distance int")
    for k in range(1, hops + 1):
        reached = around.join(frontier.select("node"), "node").select(F.col("neighbour").alias("node")).distinct()
        frontier = reached.join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(k)).checkpoint()
        found = found.unionByName(frontier)
    return found


def timeline(records: DataFrame, titles: tuple[str, ...] = ("title", "headline", "subject", "purpose", "event_type")) -> DataFrame:
    """Records of each instrument in the order of event and availability, with the first title they have."""
    title = F.coalesce(*(F.nullif(F.trim(F.col(t)), F.lit("")) for t in titles if t in records.columns), F.col("record_type"))
    entry = F.coalesce(F.col("record_id").cast("string"), content_id(F.col("record_type"), F.col("event_time").cast("string"), title))
    order = [F.col("event_time").asc_nulls_last(), F.col("available_at").asc_nulls_last(), F.col("record_type").asc(), F.col("entry_id").asc()]
    rows = records.select("instrument_id", "record_type", "event_time", "available_at", entry.alias("entry_id"), title.alias("title"))
    return numbered(rows, order, then="available_at")
