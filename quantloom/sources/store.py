"""Tables of canonical records, and raw bytes named by their content.

A table is a folder of batches, each spread over buckets by a digest of its key, and a log with a row for each batch that
was written as a whole. Readers take the batches that the log names, so a write that fails between data and log leaves
nothing that is seen. Writes are idempotent: an append compares its rows with those of the buckets it touches, and
leaves out the keys that are there; files carry Bloom filters of their keys for lookups."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quantloom.functions.ship import ship_package
from quantloom.sources.raw_files import FORMAT, RawFiles

BUCKETS = 32
LOG = "batch string, rows long, replaces array<string>"


def bucket_of(*key: str) -> Column:
    digest = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
    return (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def log(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).json(f"{root}/_log/{table}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def batches(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The rows of all committed batches that no later one replaces, with batch and _bucket; the log is a small table, so the
    join with it prunes folders."""
    said = log(spark, root, table)
    if said is None:
        return None
    live = said.select("batch").join(said.select(F.explode("replaces").alias("batch")), "batch", "left_anti")
    return spark.read.parquet(f"{root}/{table}").join(live, "batch", "left_semi")


def load(spark: SparkSession, root: str, table: str, domain: str | None = None) -> DataFrame | None:
    """A table of the store, one domain of it if asked (pruned by directory); None where there is none."""
    df = batches(spark, root, table)
    if df is None:
        return None
    return df.drop("batch", "_bucket") if domain is None else df.where(F.col("domain") == domain).drop("batch", "_bucket")


def lookup(spark: SparkSession, root: str, table: str, key: str, values: list) -> DataFrame | None:
    """The rows with one of a few key values: only their buckets are read, and of these the files that may have them."""
    df = batches(spark, root, table)
    if df is None:
        return None
    wanted = spark.createDataFrame([(v,) for v in values], f"`{key}` {dict(df.dtypes)[key]}")
    buckets = sorted({r[0] for r in wanted.select(bucket_of(key)).collect()})
    return df.where(F.col("_bucket").isin(buckets) & F.col(key).isin(values)).drop("batch", "_bucket")


def append(df: DataFrame, root: str, table: str, key: str | tuple[str, ...] = "record_id", by: str | None = "domain") -> None:
    """Add the rows whose key the table lacks, partitioned by a column if one is named: data first, then the log."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys).withColumn("_bucket", bucket_of(*keys))
    known = batches(spark, root, table)
    if known is not None:
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most BUCKETS
        there = known.where(F.col("_bucket").isin(touched)).select("_bucket", *keys)
        same = F.lit(True)
        for c in ["_bucket", *keys]:
            same = same & fresh[c].eqNullSafe(there[c])
        fresh = fresh.join(there, same, "left_anti")
    batch = "b" + uuid.uuid4().hex
    parts = ["_bucket", *([by] if by else [])]
    writer = fresh.repartition(*parts).write.partitionBy(*parts).option("parquet.bloom.filter.enabled#" + keys[0], "true")
    writer.parquet(f"{root}/{table}/batch={batch}")
    commit(spark, root, table, batch)


def commit(spark: SparkSession, root: str, table: str, batch: str, replaces: tuple[str, ...] = ()) -> None:
    """From now on readers see the batch instead of those that it replaces."""
    try:
        n = spark.read.parquet(f"{root}/{table}/batch={batch}").count()
    except AnalysisException:  # no rows, no files
        n = 0
    if n:
        spark.createDataFrame([(n, list(replaces))], LOG.split(", ", 1)[1]).coalesce(1).write.json(f"{root}/_log/{table}/batch={batch}")


def compact(spark: SparkSession, root: str, table: str, by: str | None = "domain") -> None:
    """Write all batches as one. The log's last row replaces the others; their files stay until somebody deletes them."""
    df = batches(spark, root, table)
    if df is None:
        return
    old = tuple(r[0] for r in df.select("batch").distinct().collect())  # batches, not rows
    batch = "b" + uuid.uuid4().hex
    parts = ["_bucket", *([by] if by else [])]
    df.drop("batch").repartition(*parts).write.partitionBy(*parts).parquet(f"{root}/{table}/batch={batch}")
    commit(spark, root, table, batch, old)


#: The tables of a store: (key, partitioned by).
LAYOUT = {
    "canonical": ("record_id", "domain"),
    "observations": ("observation_id", "field"),
    "record_observations": (("record_id", "observation_id"), None),
    "observation_raw": (("observation_id", "raw_ref"), None),
}
VERSION = 1


def persist(records: DataFrame, observed: DataFrame, root: str) -> None:
    """Canonical records, their observations (with canonical_record_id and raw_ref), the two link indexes and a manifest with
    the rows of each table. What is there already is left out, so that a repeated run changes nothing."""
    links = observed.select(F.col("canonical_record_id").alias("record_id"), "observation_id").where("record_id IS NOT NULL")
    raw = observed.select("observation_id", "raw_ref").where("raw_ref IS NOT NULL")
    for (table, (key, by)), rows in zip(LAYOUT.items(), (records, observed, links, raw), strict=True):
        append(rows, root, table, key, by)
    counted(records.sparkSession, root).write.mode("overwrite").json(f"{root}/manifest")


def counted(spark: SparkSession, root: str) -> DataFrame:
    """(table, rows, version) of the tables that are there."""
    tables = [(name, load(spark, root, name)) for name in LAYOUT]
    counts = [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(VERSION).alias("version")) for name, t in tables if t is not None]
    return functools.reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "table string, rows long, version int")


def layout_problems(spark: SparkSession, root: str) -> DataFrame:
    """(table, problem): tables that are missing or have other rows than the manifest says, and a manifest of another version."""
    wanted = spark.createDataFrame([(name,) for name in LAYOUT], "table string")
    try:
        said = spark.read.schema("table string, rows long, version int").json(f"{root}/manifest")
    except AnalysisException:
        said = spark.createDataFrame([], "table string, rows long, version int")
    there = counted(spark, root).select("table", F.col("rows").alias("found"))
    rows = wanted.join(said, "table", "left").join(there, "table", "left")
    problem = F.when(F.col("found").isNull(), "missing_table").when(F.col("rows").isNull(), "not_in_manifest").when(F.col("version") != VERSION, "other_version").when(F.col("rows") != F.col("found"), "other_rows")
    return rows.select("table", problem.alias("problem")).where("problem IS NOT NULL")


#: Endings of raw artifacts by media type.
ENDINGS = {
    "application/json": "json",
    "application/xml": "xml",
    "text/xml": "xml",
    "text/plain": "txt",
    "text/csv": "csv",
    "text/html": "html",
    "application/pdf": "pdf",
    "application/zip": "zip",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-excel": "xls",
}


def raw_path(source: Column, content_hash: Column, media: Column) -> Column:
    """``raw/<source>/<hh>/<hash>.<ext>``; what isn't a letter, digit, dot, dash or underscore of a source becomes one."""
    kinds = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    ending = F.coalesce(F.element_at(kinds, F.lower(F.trim(F.substring_index(media, ";", 1)))), F.lit("bin"))
    segment = F.regexp_replace(F.trim(F.coalesce(source, F.lit(""))), r"[^\p{L}\p{N}._-]", "_")
    segment = F.when(segment == "", "unknown").otherwise(segment)
    return F.concat(F.concat_ws("/", F.lit("raw"), segment, F.substring(content_hash, 1, 2), content_hash), F.lit("."), ending)


def raw_manifest(artifacts: DataFrame, source: str = "source", content: str = "content", media: str = "media_type") -> DataFrame:
    """(content_hash, size, source, path): one row for each distinct content of a source, with a path that follows from its
    hash; the ending is that of the media type, where the artifacts have one, else ``bin``."""
    kind = F.col(media).cast("string") if media in artifacts.columns else F.lit(None).cast("string")
    digest = F.sha2(F.col(content), 256)
    rows = artifacts.select(digest.alias("content_hash"), F.octet_length(content).cast("long").alias("size"), F.col(source).alias("source"), raw_path(F.col(source), digest, kind).alias("path"))
    return rows.groupBy("content_hash", "size", "source").agg(F.min("path").alias("path"))


def write_raw(artifacts: DataFrame, root: str, source: str = "source", content: str = "content", media: str = "media_type") -> None:
    """Distinct contents of each source as files named by their hash; files that are there stay as they are."""
    spark = artifacts.sparkSession
    ship_package(spark)
    spark.dataSource.register(RawFiles)
    kind = F.col(media).cast("string") if media in artifacts.columns else F.lit(None).cast("string")
    rows = artifacts.where(F.col(content).isNotNull()).select(raw_path(F.col(source), F.sha2(F.col(content), 256), kind).alias("path"), F.col(content).cast("binary").alias("content"))
    once = rows.groupBy(F.xxhash64("path").alias("_h"), "path").agg(F.any_value("content").alias("content")).drop("_h")
    once.write.format(FORMAT).mode("append").save(root)


def raw_files(spark: SparkSession, root: str, hashes: list[str] | None = None) -> DataFrame:
    """(content_hash, path, content) of the raw files, or of those with a few hashes, whose folders alone are listed."""
    ship_package(spark)
    spark.dataSource.register(RawFiles)
    reader = spark.read.format(FORMAT)
    rows = (reader if hashes is None else reader.option("hashes", json.dumps(hashes))).load(root)
    return rows.select(F.regexp_extract("path", r"([0-9a-f]{64})\.[^/]*$", 1).alias("content_hash"), "path", "content")


def corrupted(spark: SparkSession, root: str) -> DataFrame:
    """Raw files whose bytes no longer have the hash that names them."""
    return raw_files(spark, root).where(F.sha2("content", 256) != F.col("content_hash")).select("content_hash", "path")


def read_raw(spark: SparkSession, root: str, hashes: list[str] | None = None) -> DataFrame:
    """The raw files; one whose bytes no longer have the hash that names them fails the job that reads it."""
    intact = F.sha2("content", 256) == F.col("content_hash")
    wrong = F.raise_error(F.concat(F.lit("corrupted raw artifact "), F.col("content_hash"))).cast("binary")
    return raw_files(spark, root, hashes).withColumn("content", F.when(intact, F.col("content")).otherwise(wrong))


def write_dated(payloads: DataFrame, root: str, source: str = "source", content: str = "content", at: str = "retrieved_at") -> None:
    """Landed payloads as JSON rows under source, year, month and day, each with the hash of its content; a day's payload that is
    there already is left out."""
    on = F.col(at).cast("date")
    rows = payloads.select(F.col(source).alias("source"), F.year(on).alias("year"), F.month(on).alias("month"), F.dayofmonth(on).alias("day"), F.sha2(F.col(content).cast("string"), 256).alias("content_hash"), F.col(content).cast("string").alias("content"))
    keys = ["source", "year", "month", "day", "content_hash"]
    fresh = rows.dropDuplicates(keys)
    try:
        fresh = fresh.join(payloads.sparkSession.read.schema(rows.schema).json(f"{root}/landed").select(*keys), keys, "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.partitionBy("source", "year", "month", "day").mode("append").json(f"{root}/landed")
