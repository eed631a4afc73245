"""Recursive descent into JSON of any depth.

Each payload is walked once, by small helpers in Arrow batches, so that a level costs neither a pass over the table nor
another parse of what is below. Members keep the order that they have in the text; numbers keep their digits, and text that
looks like JSON stays text. What isn't JSON has neither leaves nor rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring_ascii

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.ship import ship_package

#: Objects come as tuples of pairs, lists as lists, numbers and texts as text.
_DECODER = json.JSONDecoder(object_pairs_hook=tuple, parse_float=str, parse_int=str, parse_constant=str)


class _Number(str):
    """A number as it is written, told from texts."""

    __slots__ = ()


_NUMBERED = json.JSONDecoder(object_pairs_hook=tuple, parse_float=_Number, parse_int=_Number, parse_constant=_Number)
_QUOTED = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", re.DOTALL)
LEAF = (T.StructField("path", T.ArrayType(T.StringType())), T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("node", T.StringType()))
#: Rows of a batch that is handed on.
BATCH = 20_000


def _standard(text: str) -> str:
    """Texts in single quotes, which Spark's readers take as well, in double ones."""
    inner = lambda m: "'" if m[0] == "\\'" else '\\"' if m[0] == '"' else m[0]
    return _QUOTED.sub(lambda m: m[0] if m[0][0] == '"' else '"' + re.sub(r'\\.|"', inner, m[0][1:-1]) + '"', text)


def _readable(text: str | None, numbered: bool = False) -> object:
    """The value of a JSON object or list; none where there is none."""
    decoder = _NUMBERED if numbered else _DECODER
    text = (text or "").strip(" ")
    if text[:1] not in ("{", "["):
        return None
    try:
        return decoder.raw_decode(text)[0]
    except (ValueError, RecursionError):
        pass
    try:
        return decoder.raw_decode(_standard(text))[0]
    except (ValueError, RecursionError):
        return None


def _members(value: tuple) -> list[tuple[str, int, object]]:
    """(key, at, member) of an object: what is named exactly ``value`` comes before all others of its object."""
    return sorted(((key, -1 if key == "value" else k, m) for k, (key, m) in enumerate(value)), key=lambda m: m[1])


def _leaves(value: object) -> Iterator[tuple[list[str], list[int], str | None]]:
    stack = [([], [], value)]
    while stack:
        path, place, node = stack.pop()
        if type(node) is list:
            stack += [(path, [*place, at], m) for at, m in enumerate(node)][::-1]
        elif type(node) is tuple:
            below = [([*path, key], [*place, at], m) for at, (key, m) in enumerate(node)]
            if any(key == "value" for key, _ in node):
                below = [([*path, key], [*place, at], m) for key, at, m in _members(node)]
            stack += below[::-1]
        elif node is None or isinstance(node, str):
            yield path, place, node and node.strip(" ")
        else:
            yield path, place, "true" if node else "false"


def _whole(text: str) -> str:
    """Without halves of surrogate pairs, which UTF-8 has no bytes for."""
    return text.encode("utf-8", "replace").decode()


def json_leaves(payloads: DataFrame, text: str, *keep: str, levels: int = 4) -> DataFrame:
    """(…, path, place, node): all leaves of the JSON texts, to any depth: the keys on the way, the places of the members on
    the way, by which leaves come in the order of the text, and the leaf as text, null for null. Empty objects and lists, null
    and texts that are no JSON object or list have no leaves. ``levels`` is left from descents in rounds and changes nothing."""
    ship_package(payloads.sparkSession)
    given = payloads.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*given.drop("_text").schema.fields, *LEAF])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(range(batch.num_columns - 1))
            rows, paths, places, nodes = [], [], [], []

            def flush() -> pa.RecordBatch:
                own = kept.take(pa.array(rows, pa.int32())).columns  # noqa: B023
                more = [pa.array(paths, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), pa.array(nodes, pa.string())]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, *more], names=schema.names)

            for k, payload in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                value = _readable(payload)
                escaped = value is not None and "\\ud" in payload.lower()
                for path, place, node in () if value is None else _leaves(value):
                    rows.append(k)
                    paths.append([_whole(p) for p in path] if escaped else path)
                    places.append(place)
                    nodes.append(_whole(node) if escaped and node else node)
                    if len(rows) >= BATCH:
                        yield flush()
                        rows, paths, places, nodes = [], [], [], []
            if rows:
                yield flush()

    return given.mapInArrow(found, schema)


def _row_objects(value: object, keys: tuple[str, ...]) -> list[tuple]:
    """The objects of the list of rows."""
    if type(value) is list:
        return [m for m in value if type(m) is tuple]
    stack, known = [value], frozenset(keys)
    while stack:
        node = stack.pop()
        if type(node) is list:
            if found := [m for m in node if type(m) is tuple]:
                return found
            continue
        held = dict(node)
        if not known.isdisjoint(held):
            lists = {}
            for key, m in node:
                if type(m) is list:
                    lists.setdefault(key, m)
            if named := [lists[k] for k in keys if k in lists]:
                stack.append(named[0])
                continue
        below = []
        for _, m in sorted(node, key=lambda pair: pair[0] != "value") if "value" in held else node:
            if type(m) is tuple:
                below.append(m)
            elif type(m) is list and (not m or type(m[0]) is tuple):
                below.append(m)
                break
        stack += reversed(below)
    return []


def _plain(row: tuple) -> list[str | None] | None:
    """The members of a row as text where none has a form of its own to be written in: whole numbers, texts, truth values."""
    out = []
    for _, m in row:
        if type(m) is str or m is None:
            out.append(m)
        elif m is True or m is False:
            out.append("true" if m else "false")
        elif type(m) is _Number and len(m) < 19 and m.isdigit():
            out.append(str(m))
        else:
            return None
    return out


def _written(value: object) -> str:
    """JSON of a value whose numbers are told from texts."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v if type(v) is _Number else encode_basestring_ascii(v))
        elif isinstance(v, list | tuple):
            named, parts = isinstance(v, tuple), []
            for k, m in enumerate(v):
                mark = "," if k else ""
                parts += [_Number(f"{mark}{encode_basestring_ascii(m[0])}:"), m[1]] if named else [_Number(mark), m]
            stack += [_Number("}" if named else "]"), *reversed(parts), _Number("{" if named else "[")]
        else:
            out.append("null" if v is None else "true" if v else "false")
    return "".join(out)


def nested_rows(payloads: DataFrame, text: str, *keep: str, keys: tuple[str, ...]) -> DataFrame:
    """(…, rank, row): rows (as maps of text) of the list that a payload keeps at any depth: a list is its own rows; an
    object's are those under the first of ``keys`` that is a list, else those of the first member that is a list of
    objects, or an object in which rows are found by the same rules. Ranks count the objects among the rows."""
    ship_package(payloads.sparkSession)
    given = payloads.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*given.drop("_text").schema.fields, T.StructField("rank", T.IntegerType()), T.StructField("_map", T.MapType(T.StringType(), T.StringType())), T.StructField("_row", T.StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(range(batch.num_columns - 1))
            rows, ranks, ends, names, members, texts = [], [], [0], [], [], []

            def flush() -> pa.RecordBatch:
                maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(members, pa.string()))  # noqa: B023
                own = kept.take(pa.array(rows, pa.int32())).columns  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, pa.array(ranks, pa.int32()), maps, pa.array(texts, pa.string())], names=schema.names)  # noqa: B023

            for k, payload in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                value = _readable(payload, numbered=True)
                escaped = value is not None and "\\ud" in payload.lower()
                for rank, row in enumerate(() if value is None else _row_objects(value, keys), 1):
                    plain = None if escaped else _plain(row)
                    rows.append(k)
                    ranks.append(rank)
                    if plain is not None:
                        names.extend([key for key, _ in row])
                        members.extend(plain)
                    ends.append(len(names))
                    texts.append(_written(row) if plain is None else None)
                    if len(rows) >= BATCH:
                        yield flush()
                        rows, ranks, ends, names, members, texts = [], [], [0], [], [], []
            if rows:
                yield flush()

    row = F.when(F.col("_row").isNull(), F.col("_map")).otherwise(F.from_json("_row", "map<string,string>"))
    return given.mapInArrow(found, schema).select(*keep, "rank", row.alias("row"))
