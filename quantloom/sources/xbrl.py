"""XBRL filings as tables: contexts, units and facts are read by a small helper in Arrow batches; a fact finds its context
and unit in its own filing, so that nothing is joined.

Facts are the elements with a context, at any depth. Numbers are decimals. An element with a context that has elements but no text of its own is no fact.
Filings that are not XML, and null, have no rows; ``unparsed`` names them. Repeated filings give repeated rows; texts that
look like numbers come in their plain form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quantloom.functions.ship import ship_package

NUMBER = "decimal(38,8)"
#: Elements that hold no facts.
CONTAINERS = ("context", "unit", "schemaRef", "footnoteLink", "labelLink", "referenceLink", "roleRef", "arcroleRef")


def _plain(name: Column) -> Column:
    return F.element_at(F.split(name, ":"), -1)


def contexts(filings: DataFrame, xml_col: str = "xml", id_col: str = "filing_id") -> DataFrame:
    """(filing_id, context_ref, period_start, period_end, instant, dimensions)"""
    return _opened(filings, xml_col, id_col, CONTEXT).select("filing_id", "context_ref", *_period()).dropDuplicates(["filing_id", "context_ref"])


def _period() -> list[Column]:
    entries = F.transform("members", lambda m: F.struct(_plain(m["dimension"]), F.trim(m["value"])))
    on = lambda c: F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")
    return [on("start").alias("period_start"), on("end").alias("period_end"), on("instant").alias("instant"), F.map_from_entries(F.array_distinct(entries)).alias("dimensions")]


def units(filings: DataFrame, xml_col: str = "xml", id_col: str = "filing_id") -> DataFrame:
    """(filing_id, unit_ref, unit): the measure, of ratios the numerator's, else the name of the unit."""
    return _opened(filings, xml_col, id_col, UNIT).dropDuplicates(["filing_id", "unit_ref"])


_TEXT = T.StringType()
_MEMBERS = T.ArrayType(T.StructType([T.StructField("dimension", _TEXT), T.StructField("value", _TEXT)]))
ELEMENT = tuple(T.StructField(n, _TEXT) for n in ("concept", "context_ref", "unit_ref", "decimals", "scale", "nil", "text"))
CONTEXT = (*(T.StructField(n, _TEXT) for n in ("context_ref", "start", "end", "instant")), T.StructField("members", _MEMBERS))
UNIT = (T.StructField("unit_ref", _TEXT), T.StructField("unit", _TEXT))
FACT = (*ELEMENT, *CONTEXT[1:], UNIT[1])
#: Rows of a batch that is handed on.
BATCH = 20_000
_PLAIN = re.compile(r"[+-]?\d{1,38}(?:\.\d*)?")


def _parts(xml: str) -> dict[tuple, list[tuple]]:
    """The contexts, the units and the elements that may be facts, whatever their depth, of a filing: those have a context, and
    a text of their own or no elements."""
    found, contexts, units, open_, skipped = [], [], [], [], 0
    #: of a context or unit: its kind and id, the way into it with attributes and texts, and what was found
    held, way, values = None, [], {}
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, attributes: dict) -> None:
        nonlocal skipped, held
        concept = name.rsplit(":", 1)[-1]
        named = {k.rsplit(":", 1)[-1]: v.strip() for k, v in attributes.items()}
        if held:
            way.append((concept, named, []))
            return
        if open_:
            open_[-1]["below"] = True
        if not skipped and len(open_) == 1 and concept in ("context", "unit"):
            held = (concept, named.get("id"))
        elif skipped or (open_ and (concept in CONTAINERS or concept.startswith("_"))):
            skipped += 1
        else:
            element = {"concept": concept, "named": named, "texts": [], "below": False}
            found.extend([element] if open_ else [])
            open_.append(element)

    def end(_: str) -> None:
        nonlocal skipped, held
        if held and way:
            _, named, texts = way[-1]
            values.setdefault("/".join(w[0] for w in way), []).append((named.get("dimension"), " ".join(texts)))
            way.pop()
        elif held:
            kind, own = held
            last = lambda key: values.get(key, [(None, None)])[-1][1] or None
            if own is not None and kind == "context":
                of = [m for holder in ("entity/segment", "scenario") for part in ("explicitMember", "typedMember") for m in values.get(f"{holder}/{part}", ())]
                members = [{"dimension": d, "value": v} for d, v in of if d is not None and v]
                contexts.append((own, last("period/startDate"), last("period/endDate"), last("period/instant"), members))
            elif own is not None:
                units.append((own, last("measure") or last("divide/unitNumerator/measure") or own))
            held = None
            values.clear()
        elif skipped:
            skipped -= 1
        else:
            open_.pop()

    def data(text: str) -> None:
        if text.strip() and not skipped and (way or open_):
            (way[-1][2] if way else [] if held else open_[-1]["texts"]).append(text.strip())

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(xml.strip(), True)
    except (expat.ExpatError, ValueError):
        return {}
    facts = [
        (e["concept"], *(e["named"].get(n) for n in ("contextRef", "unitRef", "decimals", "scale", "nil")), _written(e["texts"]))
        for e in found if "contextRef" in e["named"] and (e["texts"] or not e["below"])
    ]
    # the first of a name counts
    periods, measures = {c[0]: c[1:] for c in reversed(contexts)}, dict(reversed(units))
    whole = [(*f, *periods.get(f[1], (None, None, None, None)), measures.get(f[2])) for f in facts]
    return {FACT: whole, CONTEXT: contexts, UNIT: units}


def _written(texts: list[str]) -> str | None:
    """The text, numbers in their plain form."""
    text = " ".join(texts)
    if not _PLAIN.fullmatch(text):
        return text or None
    plain = format(Decimal(text), "f")
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return "0" if plain in ("-0", "") else plain


def _opened(filings: DataFrame, xml_col: str, id_col: str, part: tuple) -> DataFrame:
    """The FACT, CONTEXT or UNIT rows of all filings."""
    ship_package(filings.sparkSession)
    given = filings.select(F.col(id_col).alias("filing_id"), F.col(xml_col).alias("xml"))
    schema = T.StructType([given.schema["filing_id"], *part])
    types = [to_arrow_type(f.dataType) for f in part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []

            def flush() -> pa.RecordBatch:
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=schema.names)  # noqa: B023

            for k, xml in enumerate(batch.column(1).to_pylist()):
                own = _parts(xml or "").get(part, ())
                at.extend([k] * len(own))
                rows.extend(own)
                if len(rows) >= BATCH:
                    yield flush()
                    at, rows = [], []
            if rows:
                yield flush()

    return given.mapInArrow(read, schema)


def raw_facts(filings: DataFrame, xml_col: str = "xml", id_col: str = "filing_id") -> DataFrame:
    """(filing_id, concept, context_ref, unit_ref, decimals, text, value): numbers may have thousands separators and a scale;
    what is marked as nil has neither text nor value."""
    return _typed(filings, xml_col, id_col).select("filing_id", "concept", "context_ref", "unit_ref", "decimals", "text", "value")


def _typed(filings: DataFrame, xml_col: str, id_col: str) -> DataFrame:
    facts = _opened(filings, xml_col, id_col, FACT).withColumn("scale", F.col("scale").try_cast("int"))
    facts = facts.withColumn("text", F.when(~F.coalesce(F.col("nil") == "true", F.lit(False)), F.trim("text")))
    number = F.regexp_replace("text", ",", "").try_cast(NUMBER)
    power = F.pow(F.lit(10.0), F.abs(F.coalesce("scale", F.lit(0)))).cast("decimal(18,0)")
    scaled = F.when(F.coalesce("scale", F.lit(0)) >= 0, number * power).otherwise(number / power).cast(NUMBER)
    return facts.withColumn("value", scaled)


def facts(filings: DataFrame, xml_col: str = "xml", id_col: str = "filing_id") -> DataFrame:
    """A row for each fact of each filing, with its period, dimensions and unit; facts of unknown contexts keep empty ones."""
    found = _typed(filings, xml_col, id_col).select("filing_id", "concept", "value", "text", "context_ref", "unit", "decimals", *_period())
    return found.withColumn("dimensions", F.coalesce("dimensions", F.create_map().cast("map<string,string>")))


def unparsed(filings: DataFrame, xml_col: str = "xml", id_col: str = "filing_id") -> DataFrame:
    """Issue rows for filings that have no fact."""
    having = raw_facts(filings, xml_col, id_col).select(F.col("filing_id").alias(id_col)).distinct()
    return filings.select(id_col).join(having, id_col, "left_anti").withColumn("code", F.lit("parse_failed"))
