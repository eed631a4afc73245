"""Shared pieces of the training-data operators: the shared folder, written tables, word rules."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.functions.ship import ship_package

#: The white space that separates words, as a character class for Java and RE2.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` where it is set. A session within
    one process may do without; on a cluster there is no folder to guess, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str, rows: int | None = None, rows_per_task: int = 100_000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    is computed once and has sizes that adaptive execution can see. A bound on its ``rows``, where the caller has one,
    saves a small table from being written by many tasks with a file each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None and (tasks := rows // rows_per_task + 1) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(max(tasks, spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files that ``df``, a table that ``materialise`` wrote and nothing reads any more, was read from."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``LOOM_TOKENIZERS`` overrides the installed package."""
    if root := os.environ.get("LOOM_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Results of ``compute`` by key, for repeated words. Two generations of ``size`` entries bound it: a full one becomes
    the older one, from which what is asked for again moves on. Keys above ``longest`` characters are never kept."""

    def __init__(self, compute: Callable[[str], bytes], size: int = 40_000, longest: int = 40):
        super().__init__()
        self.compute, self.size, self.longest, self.older = compute, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > self.longest:
            return self.compute(key)
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` of mapInArrow, after which the worker gives free memory back: Spark goes on using its process in stages
    that need it for something else."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def small_batches(df: DataFrame, rows: int = 400, size: str = "4m") -> DataFrame:
    """Bounds the rows and bytes that an Arrow batch of the session holds, so that a batch of long texts fits in a
    worker, and makes sure that workers have the package."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df
