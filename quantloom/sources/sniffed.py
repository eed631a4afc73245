"""Landed files of unknown form: compressed or not, one array, one object, an object with its rows under ``data``, or an
object a line. What a file is comes from its first bytes, not from its name."""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.functions.ship import ship_package

ROWS = 1000
SCHEMA = "path string, rank long, row string, code string"


def lines_of(content: pa.Buffer) -> Iterator[bytes]:
    """Lines of the bytes, decompressed piece by piece if they begin like gzip (several members too)."""
    if content[:2].to_pybytes() != b"\x1f\x8b":
        yield from io.BufferedReader(pa.BufferReader(content), 1 << 16)
        return
    rest, at = b"", 0
    while at < content.size:
        unpack = zlib.decompressobj(31)
        while at < content.size and not unpack.eof:
            piece = content[at : at + (1 << 16)].to_pybytes()
            at += len(piece)
            *whole, rest = (rest + unpack.decompress(piece)).split(b"\n")
            yield from whole
        at -= len(unpack.unused_data)
        if not unpack.eof:
            break  # cut off: what there is has been read
    if rest:
        yield rest


def rows_of(content: pa.Buffer) -> Iterator[tuple[str | None, str | None]]:
    """(row, code): each object as JSON text; lines that are none, and whole texts of another shape, with a code instead."""
    lines = lines_of(content)
    try:
        first = next((x for x in lines if x.strip()), b"").strip().removeprefix(b"\xef\xbb\xbf")
        if not first:
            return
        if _object(first) is not None:
            second = next((x for x in lines if x.strip()), None)
            if second is not None or "data" not in json.loads(first):
                for line in (first, *(() if second is None else (second,)), *lines):
                    if line.strip():
                        yield (line.strip().decode("utf-8"), None) if _object(line) is not None else (None, "bad_line")
                return
            whole = first
        else:
            whole = b"\n".join([first, *(x.rstrip(b"\r\n") for x in lines)])
        try:
            found = json.loads(whole)
        except ValueError:
            for line in whole.split(b"\n"):
                if line.strip():
                    yield (line.strip().decode("utf-8"), None) if _object(line) is not None else (None, "bad_line")
            return
    except (UnicodeDecodeError, zlib.error):
        yield None, "unreadable"
        return
    if isinstance(found, dict):
        found = found["data"] if isinstance(found.get("data"), list) else [found]
    if not isinstance(found, list):
        yield None, "unknown_shape"
        return
    for row in found:
        if isinstance(row, dict):
            yield json.dumps(row, ensure_ascii=False), None


def _object(line: bytes) -> dict | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(path, rank, row, code): the objects of all files of a folder as JSON texts, in their order, from 0. Members of arrays
    that are no objects are left out; a line that is none, a file that can't be read or has another shape gives a row with a
    code. A file is read by one task: lines one by one, an array or object whole."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str, begin: int, some: list) -> pa.RecordBatch:
            ranks = pa.array(range(begin, begin + len(some)), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(some)), ranks, pa.array([r for r, _ in some], pa.string()), pa.array([c for _, c in some], pa.string())], ["path", "rank", "row", "code"])

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                begin, some = 0, []
                for row in rows_of(content.as_buffer()):
                    some.append(row)
                    if len(some) == ROWS:
                        yield out(name, begin, some)
                        begin, some = begin + ROWS, []
                if some:
                    yield out(name, begin, some)

    return files.mapInArrow(run, SCHEMA)
