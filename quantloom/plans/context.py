"""Bounded selections of results for many instruments at once, and their text.

Selection is greedy in section order under two budgets. Both become running sums over one window by instrument: an
item is taken while fewer than ``max_items`` were taken before it, a series gets what is left of ``max_points`` and
takes part only if that is anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.plans.policies import POLICIES, Policy

#: Budgets of the profiles, items and points.
LIMITS = {"compact": (24, 500), "medium": (40, 1600), "full": (100, 8000), "wide": (180, 4000)}
KINDS = ("summary", "observation", "series")


@dataclass(frozen=True)
class Section:
    name: str
    prefixes: tuple[str, ...] = ()
    kinds: tuple[str, ...] = KINDS
    max_points: int | None = None
    records: tuple[str, ...] = ()
    max_records: int | None = None
    newest: bool = True


def _facts(name: str, most: int, *types: str) -> Section:
    return Section(name, kinds=(), records=types, max_records=most)


#: The sections of the compact profile.
COMPACT = (
    _facts("identity_facts", 2, "Instrument", "SectorClassification"),
    _facts("recent_market_facts", 30, "PriceBar"),
    _facts("fundamental_facts", 8, "FundamentalSnapshot"),
    _facts("ownership_facts", 8, "ShareholdingSnapshot"),
    _facts("event_facts", 20, "CorporateAction", "CompanyEvent", "Filing", "NewsItem"),
    Section("summaries", ("historical_state_", "historical_percentiles", "volatility_state", "trend_state", "historical_extremes", "persistence", "return_", "volatility_"), ("summary", "observation")),
    Section("recent_market", ("close", "return_", "realized_volatility_", "drawdown", "sma_"), ("observation", "series"), 30),
    Section("weekly_context", ("week_return",), ("observation", "series"), 52),
    Section("monthly_context", ("month_return",), ("observation", "series"), 60),
)


def _all_facts(prices: int, statements: int, owners: int, events: int, market: str = "recent_market_facts") -> tuple[Section, ...]:
    return (
        _facts("identity_facts", 2, "Instrument", "SectorClassification"), _facts(market, prices, "PriceBar"), _facts("fundamental_facts", statements, "FundamentalSnapshot"),
        _facts("ownership_facts", owners, "ShareholdingSnapshot"), _facts("event_facts", events, "CorporateAction", "CompanyEvent", "Filing", "NewsItem"),
    )


#: The sections of the other profiles. Summaries come with observations.
SUMMED = ("summary", "observation")
MEDIUM = (
    *_all_facts(90, 20, 12, 40),
    Section("summaries", ("historical_state_", "historical_percentiles", "volatility_state", "trend_state", "historical_extremes", "persistence", "return_", "volatility_"), SUMMED),
    Section("recent_market", ("close", "return_", "realized_volatility_", "drawdown", "sma_", "liquidity_"), ("observation", "series"), 90),
    Section("weekly_context", ("week_return",), ("observation", "series"), 156),
    Section("monthly_context", ("month_return",), ("observation", "series"), 120),
)
FULL = (
    *_all_facts(252, 40, 20, 100, "market_facts"),
    Section("summaries", (), SUMMED),
    Section("market_series", ("return_", "realized_volatility_", "drawdown", "sma_", "liquidity_"), ("observation", "series"), 252),
)
WIDE = (
    _facts("identity", 4, "Instrument", "SectorClassification"),
    _facts("market_and_indices", 252, "PriceBar", "IndexSnapshot", "IndexPriceBar"),
    _facts("fundamentals", 48, "FundamentalSnapshot", "Filing"),
    _facts("ownership_and_events", 60, "ShareholdingSnapshot", "InsiderTransaction", "LargeDeal", "CorporateAction", "CompanyEvent"),
    _facts("news_and_social", 80, "NewsItem", "SocialPost"),
    _facts("macro", 60, "MacroObservation", "MacroRelease"),
    Section("derived_research", (), SUMMED),
    Section("derived_market_series", ("return_", "realized_volatility_", "drawdown", "sma_", "rsi_", "macd", "liquidity_"), ("observation", "series"), 252),
)
PROFILES = {"compact": COMPACT, "medium": MEDIUM, "full": FULL, "wide": WIDE}


def profile(name: str, items: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A profile's (selected items, selected records) of every instrument."""
    most_items, most_points = LIMITS[name]
    sections = PROFILES[name]
    return select_items(items, [s for s in sections if s.kinds], most_items, most_points), select_records(records, list(sections))


def compact(items: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return profile("compact", items, records)


def select_records(records: DataFrame, sections: list[Section]) -> DataFrame:
    """(instrument_id, section, record_id, position) of the records (instrument_id, record_id, record_type, at) that sections
    ask for: the newest (or first) ``max_records`` of their types, in the order of time; a record that two sections take
    is in the first one. Records take nothing from the budgets of items."""
    wanted = [(k, s) for k, s in enumerate(sections) if s.records]
    each = F.array(*(F.when(F.col("record_type").isin(*s.records), F.struct(F.lit(k).alias("place"), F.lit(s.name).alias("section"), F.lit(s.max_records).cast("long").alias("most"), F.lit(s.newest).alias("newest"))) for k, s in wanted))
    rows = records.select("instrument_id", "record_id", "at", F.inline(F.array_compact(each)))
    group = ("instrument_id", "place")
    up, down = (Window.partitionBy(*group).orderBy(*order) for order in (("at", "record_id"), (F.desc("at"), F.desc("record_id"))))
    rows = rows.withColumn("k", F.when(F.col("newest"), F.row_number().over(down)).otherwise(F.row_number().over(up))).where("most IS NULL OR k <= most")
    once = rows.groupBy("instrument_id", "record_id").agg(F.min(F.struct("place", "section", "at")).alias("m")).select("instrument_id", "record_id", "m.*")
    order = Window.partitionBy("instrument_id").orderBy("place", "at", "record_id")
    return once.select("instrument_id", "section", "record_id", F.row_number().over(order).cast("long").alias("position"))


def pack_ids(selected: DataFrame) -> DataFrame:
    """(instrument_id, pack_id): a hash of what an instrument's selection holds, in order. A selection is bounded."""
    entry = F.concat_ws(":", "section", "kind", "item_id", F.coalesce(F.col("included_points").cast("string"), F.lit("")))
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))), lambda x: x["e"])
    return selected.groupBy("instrument_id").agg(gathered.alias("held")).select("instrument_id", F.sha2(F.concat_ws("|", F.col("instrument_id").cast("string"), F.array_join("held", "|")), 256).alias("pack_id"))


def json_lines(df: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """(header: the columns that are the same in all rows, rows with one column ``line``: the other columns as JSON without nulls)."""
    rows, header = shaped(df, keep=tuple(c for c in df.columns if c.endswith(("_id", "_ids"))))
    return header, rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def select_items(items: DataFrame, sections: list[Section], max_items: int, max_points: int) -> DataFrame:
    """``items`` (instrument_id, item_id, kind, metric, points) to those selected, with section, position, the points
    included and the points that the budget cut off.

    An item belongs to the first section that takes it; equal ids count once."""
    once = items.groupBy("instrument_id", "item_id").agg(F.min(F.struct("kind", "metric", "points")).alias("i")).select("instrument_id", "item_id", "i.*")
    place, cap = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, s in reversed(list(enumerate(sections))):
        fits = F.col("kind").isin(*s.kinds)
        if s.prefixes:
            fits = fits & F.col("metric").rlike("^(" + "|".join(p.replace(".", r"\.") for p in s.prefixes) + ")")
        place, cap = F.when(fits, k).otherwise(place), F.when(fits, F.lit(s.max_points).cast("long")).otherwise(cap)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = once.withColumn("place", place).withColumn("cap", cap).where("place IS NOT NULL").withColumn("k", kind)
    series = F.col("kind") == "series"
    rows = rows.withColumn("wanted", F.when(series, F.least(F.col("points"), F.coalesce("cap", "points"))).otherwise(0))
    rows = rows.where(~series | (F.col("wanted") > 0))
    order = Window.partitionBy("instrument_id").orderBy("place", "k", "item_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum("wanted").over(before), F.lit(0))).where(~series | (F.col("used") < max_points))
    rows = rows.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= max_items)
    included = F.when(series, F.least(F.col("wanted"), F.lit(max_points) - F.col("used")))
    name = F.element_at(F.array(*(F.lit(s.name) for s in sections)), F.col("place") + 1)
    return rows.select("instrument_id", "item_id", "kind", "metric", name.alias("section"), "position", included.cast("long").alias("included_points"), F.when(series, F.col("wanted") - included).cast("long").alias("omitted_points"))


def last_points(points: DataFrame, selected: DataFrame) -> DataFrame:
    """The latest ``included_points`` of each selected series, from (instrument_id, item_id, ts, value)."""
    rows = points.join(selected.where("kind = 'series'").select("instrument_id", "item_id", "included_points"), ["instrument_id", "item_id"])
    order = Window.partitionBy("instrument_id", "item_id").orderBy(F.col("ts").desc())
    return rows.withColumn("back", F.row_number().over(order)).where("back <= included_points").drop("back", "included_points")


#: Fields that carry plumbing and no content.
PLUMBING = (
    "algorithm", "algorithm_version", "calculated_at", "calculation_basis", "canonical_record_id", "content_hash", "decision_id", "derived_id", "enricher", "enricher_version",
    "finding_id", "instrument_ids", "lineage", "local_path", "metadata", "observation_id", "pack_id", "parameters", "provenance", "quality_ids", "raw_artifact_ids", "raw_ref",
    "record_id", "relationship_id", "sha256", "source_observation_ids", "source_record_ids", "text_ref",
)


def expanded(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the members of flat structs among ``fields`` as columns ``field.member``; others stay as they are."""
    out = []
    for f in df.schema:
        flat = isinstance(f.dataType, T.StructType) and not any(isinstance(x.dataType, (T.StructType, T.ArrayType, T.MapType)) for x in f.dataType)
        if f.name in fields and flat:
            out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}.{x.name}") for x in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def prepared(df: DataFrame, expand: tuple[str, ...] = (), drop: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Records for reading: flat structs opened, plumbing and ``drop`` left out, then ``shaped``. The source of records comes from
    their provenance."""
    if "provenance" in df.columns and "source" not in df.columns and isinstance(df.schema["provenance"].dataType, T.StructType) and "source" in df.schema["provenance"].dataType.names:
        df = df.withColumn("source", F.col("provenance.source"))
    return shaped(expanded(df, expand), (*PLUMBING, *drop), keep)


def by_policy(df: DataFrame, record_type: str) -> tuple[DataFrame, dict[str, str]]:
    """Records of one type for reading: what its policy (none for other types) leaves out is gone, members of what it opens
    are columns, and columns come in its order, then the rest as they were."""
    policy = POLICIES.get(record_type, Policy())
    keep = tuple(c for c in policy.order if c in df.columns and c.endswith(("_id", "_ids")))
    rows, header = prepared(df, policy.expand, policy.drop, keep)
    place = {c: k for k, c in enumerate((*policy.order, *(e for e in policy.expand if e not in policy.order)))}
    ordered = sorted(rows.columns, key=lambda c: place.get(c, place.get(c.split(".")[0], len(place))))
    return rows.select(*(F.col(f"`{c}`") for c in ordered)), header


def shaped(df: DataFrame, drop: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """(rows without plumbing, empty and constant columns, {constant column: its value}), after one aggregation."""
    columns = [c for c in df.columns if c in keep or (c not in drop and not c.endswith(("_id", "_ids")))]
    of = lambda c: F.col(f"`{c}`")
    told = df.agg(F.count(F.lit(1)).alias("rows"), *(F.struct(F.count(of(c)).alias("n"), F.min(of(c).cast("string")).alias("a"), F.max(of(c).cast("string")).alias("z")).alias(f"c{k}") for k, c in enumerate(columns))).first()
    by_name = {c: told[f"c{k}"] for k, c in enumerate(columns)}
    constant = {c: t["a"] for c, t in by_name.items() if told["rows"] > 1 and t["n"] == told["rows"] and t["a"] == t["z"] and c not in keep}
    return df.select(*(of(c) for c in columns if by_name[c]["n"] and c not in constant)), constant


#: Fields whose cells are shortened, and to how many characters.
LIMITED = {"text": 900}


def cell(name: str, markdown: bool):
    text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    if limit := LIMITED.get(name):
        text = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)
    return F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("|"), F.lit(r"\|")) if markdown else text


def lines(df: DataFrame, style: str = "markdown") -> tuple[str, DataFrame]:
    """(head, rows with one column ``line``): rows stay distributed and can be written as text."""
    names = df.columns
    if style == "markdown":
        head = "| " + " | ".join(names) + " |\n|" + "---|" * len(names)
        return head, df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c, True) for c in names)), F.lit(" |")).alias("line"))
    sign = {"csv": ",", "tsv": "\t"}[style]
    return sign.join(names), df.select(F.to_csv(F.struct(*(cell(c, False).alias(c) for c in names)), {"sep": sign}).alias("line"))


def pack_text(selected: DataFrame) -> DataFrame:
    """(instrument_id, text): a Markdown list of each instrument's selection. A selection is bounded by ``max_items``,
    so gathering it by instrument is too."""
    line = F.concat(F.lit("- "), "section", F.lit(" / "), "metric", F.coalesce(F.concat(F.lit(" ("), F.col("included_points").cast("string"), F.lit(" points)")), F.lit("")))
    gathered = F.sort_array(F.collect_list(F.struct("position", line.alias("line"))))
    return selected.groupBy("instrument_id").agg(F.array_join(F.transform(gathered, lambda x: x["line"]), "\n").alias("text"))
