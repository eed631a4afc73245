"""Near-duplicate classes by DartMinHash signatures, banded joining and verified links.

A document is the multiset of its runs of ``words`` words; each distinct run is an element whose weight is its count,
and similarity is the sum of the smaller weights over the sum of the larger ones.

* Signature. Hashed darts fall on the plane of (weight, rank) of every element, one per unit of area on average (a
  Poisson number per unit square, fixed by a hash of element and square). A document gets the darts below its weights,
  up to the rank at which about ``darts`` of them have fallen. Each dart belongs to one of ``bands * rows``
  coordinates, and the earliest dart per coordinate is the signature: two documents agree on a coordinate with the
  probability of their similarity, at a cost of weight plus darts instead of weight times coordinates.
* Classes. Documents with equal multisets are one node. Nodes that agree on all ``rows`` coordinates of a band share a
  bucket.
* Bounds. Runs that no other node in a shared bucket has can be common to no pair; and where the parities of two
  multisets, hashed to ``64 * PARITIES`` bits, differ in d bits, the multisets differ in d runs or more. Both bound the
  similarity of a pair from above inside the join, before it is emitted, and never exclude a link.
* Links. In the first round every bucket compares its members with the one of the least share of own runs. Verified
  links join nodes; then
  only buckets with members of several components go on, the members outside a bucket's largest component being
  compared with all others, some in each round and more in each later one, until no bucket has an untried pair of
  different components. So no bucket is expanded into all pairs unless it is of nothing but unlinked nodes, yet every
  pair of a bucket is either tried or already in one class.

A pair is linked if its similarity is at least ``threshold``, from the 64-bit hashes of its runs. With 24 bands of 5
rows a pair at 0.8 shares no bucket with probability 7e-5, one at 0.9 with 3e-10.

What is returned is one row for each document with its class; pairs within a class that are already joined by others are not
compared, so links are not counted. Against all pairs of 1,000 documents, all 102 pairs at 0.8 or more were in one class.

Defined results: null text is empty; a null id stands before all others, as the id -2**63, which no row may have beside it; a
text without words is a class of its own row; a text of under ``words`` words is
one run; rows repeated with their id and text are members of their class; a class is named by its smallest id (null
ids come first); an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import materialise, small_batches, tidy, unused
from quantloom.llm.graph import components
from quantloom.llm.hashing import U, mix, shingles

#: Poisson(1) distribution function as 64-bit thresholds: how many darts a unit square holds.
_mass = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)]))
POISSON = (np.minimum(np.cumsum(_mass), 1 - 2.0**-53) * 2.0**64).astype(np.uint64)
GOLDEN = U(0x9E3779B97F4A7C15)


PARITIES = 8
PARITY_COLUMNS = [f"p{k}" for k in range(PARITIES)]


def cells_of(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight of each element."""
    unit = np.arange(int(weights.sum()), dtype=np.uint64) - np.repeat(np.cumsum(weights) - weights, weights).astype(np.uint64)
    return mix(np.repeat(elements, weights) + unit * GOLDEN)


def parities(cells: np.ndarray) -> np.ndarray:
    """For each of ``64 * PARITIES`` bits whether an odd number of units falls on it, as signed 64-bit words."""
    odd = np.bincount((mix(cells ^ GOLDEN) % U(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def dart_signature(elements: np.ndarray, weights: np.ndarray, coordinates: int, darts: int) -> np.ndarray:
    """The earliest dart of each coordinate; 0 where none fell."""
    signature = np.zeros(coordinates, np.uint64)
    total = int(weights.sum())
    if not total:
        return signature
    rank_limit = darts / total
    layers = np.arange(int(np.ceil(rank_limit)), dtype=np.uint64)
    cells = cells_of(elements, weights)
    squares = mix(cells[:, None] ^ ((layers + U(1)) * U(0xC2B2AE3D27D4EB4F))[None, :]).ravel()
    number = np.searchsorted(POISSON, squares, "right")
    source = np.repeat(np.arange(len(squares)), number)
    which = np.arange(len(source), dtype=np.uint64) - np.repeat(np.cumsum(number) - number, number).astype(np.uint64)
    dart = mix(squares[source] + (which + U(1)) * U(0xA24BAED4963EE407))
    rank = (source % len(layers)) + (mix(dart ^ GOLDEN) >> U(11)) * 2.0**-53
    near = rank < rank_limit
    dart, rank = dart[near], rank[near]
    order = np.argsort(-rank)
    dart = dart[order]
    signature[(mix(dart + GOLDEN) % U(coordinates)).astype(np.int64)] = dart | U(1)  # the last one written has the lowest rank
    return signature


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> list[int | None]:
    parts = signature.reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = mix(total * GOLDEN + parts[:, k])
    return [x if full else None for x, full in zip(total.view(np.int64).tolist(), (parts != 0).all(1), strict=True)]


def signatures(docs: DataFrame, words: int, bands: int, rows: int, darts: int) -> DataFrame:
    """(id, version, one, two, weight, bands): a 128-bit hash of the multiset, its weight, a hash for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, weight, hashed = [], [], [], []
            for text in batch.column("text").to_pylist():
                elements, counts = shingles((text or "").encode(), words)
                cells = mix(elements + counts.astype(np.uint64) * GOLDEN)
                one.append(int(cells.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(cells ^ GOLDEN).sum(dtype=np.uint64).view(np.int64)))
                weight.append(int(counts.sum()))
                signature = dart_signature(elements, counts, bands * rows, darts)
                hashed.append(band_hashes(signature, bands, rows) if weight[-1] else [])
            numbers = [pa.array(x, pa.int64()) for x in (one, two, weight)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("version"), *numbers, pa.array(hashed, pa.list_(pa.int64()))],
                ["id", "version", "one", "two", "weight", "bands"],
            )

    return docs.mapInArrow(tidy(run), "id long, version long, one long, two long, weight long, bands array<long>")


def multisets(texts: DataFrame, words: int) -> DataFrame:
    """(node, runs, parities): distinct runs as sorted 64-bit hashes, then their counts, in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles((x or "").encode(), words) for x in batch.column("text").to_pylist()]
            packed = [e.tobytes() + c.astype("<u4").tobytes() for e, c in found]
            odd = np.stack([parities(cells_of(e, c)) for e, c in found]).T
            columns = [batch.column("node"), pa.array(packed, pa.binary()), *map(pa.array, odd)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "runs", *PARITY_COLUMNS])

    return texts.mapInArrow(tidy(run), "node long, runs binary, " + ", ".join(f"{c} long" for c in PARITY_COLUMNS))


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    n, m = len(a) // 12, len(b) // 12
    x, y = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    c, d = np.frombuffer(a, "<u4", n, 8 * n).astype(np.int64), np.frombuffer(b, "<u4", m, 8 * m).astype(np.int64)
    at = np.searchsorted(y, x)
    at[at == m] = 0
    both = y[at] == x if m else np.zeros(n, bool)
    common = np.minimum(c[both], d[at[both]]).sum()
    return common / max(c.sum() + d.sum() - common, 1)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(ra, rb) of the pairs (a, b, ra, rb) of nodes and their components whose multisets are at least ``threshold`` alike."""
    one = sets.select(F.col("node").alias("a"), F.col("runs").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("runs").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("ra", "rb", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [similarity(x, y) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            kept = batch.select(["ra", "rb"]).filter(pa.array(alike, pa.bool_()))
            if kept.num_rows:
                yield kept

    return joined.mapInArrow(tidy(run), "ra long, rb long")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, similarity) of the multisets of the pairs (a, b): one comparison for each text, however large its class is."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [similarity(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(alike, pa.float64())], ["a", "similarity"])

    return joined.select("a", "x", "y").mapInArrow(tidy(run), "a long, similarity double")


def own_runs(sets: DataFrame) -> DataFrame:
    """(node, own): how many distinct runs of each node no other node has; nodes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("runs").to_pylist()
            sizes = [len(x) // 12 for x in packed]
            runs = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(packed, sizes, strict=True)])
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(nodes)], ["run", "node"])

    once = sets.mapInArrow(tidy(run), "run long, node long").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    return once.where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def moved(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``rows`` with root replaced by what ``mapping`` (node, root) says of it."""
    to = mapping.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return rows.join(to, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def merges(members: DataFrame, sets: DataFrame, threshold: float, first_centers: int = 8) -> list[DataFrame]:
    """Mappings (node, root) to apply one after the other to nodes that begin as their own roots, from bucket members
    (bucket, band, node, bands, weight, own, parities). Later mappings join whole components, so they are small.

    The first round has one centre a bucket. After it, a node that one of its buckets chooses as centre is centre in
    all of them, and a pair is tried in the first band that both nodes share, so each pair comes out of the join once."""
    carried = ("node", "root", "weight", "own", "bands", *PARITY_COLUMNS)

    def may_link(row: str, center: str) -> Column:
        common = F.least(F.expr(f"{row}weight - {row}own"), F.expr(f"{center}weight - {center}own"))
        both = F.col(f"{row}weight") + F.col(f"{center}weight")
        differ = F.expr(" + ".join(f"bit_count({row}{c} ^ {center}{c})" for c in PARITY_COLUMNS))
        within = differ <= both * ((1 - threshold) / (1 + threshold)) + 1e-6
        return (common >= F.lit(threshold) * (both - common) - 1e-6) & within

    first_shared = F.array_position(F.zip_with("bands", "center_bands", lambda x, y: x == y), True) == F.col("band") + 1

    def tried(centers: DataFrame, others: DataFrame, where: Column) -> DataFrame:
        pairs = others.join(centers, "bucket").where((F.col("root") != F.col("center_root")) & may_link("", "center_") & where)
        one, two = F.struct("node", "root"), F.struct(F.col("center_node").alias("node"), F.col("center_root").alias("root"))
        pairs = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))
        return materialise(verified(pairs.distinct(), sets, threshold), "links")

    def as_centers(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", *(F.col(c).alias(f"center_{c}") for c in carried))

    # a partner within the bounds weighs at most this, so a bucket of heavier nodes has none
    heaviest = (F.col("weight") - F.col("own")) * ((1 + threshold) / threshold) - F.col("weight")
    members = materialise(members.withColumn("root", F.col("node")), "bounded")
    lightest = members.groupBy("bucket").agg(F.min("weight").alias("lightest"))
    active = members.join(lightest, "bucket").where(heaviest >= F.col("lightest") - 1e-6).drop("lightest")
    n_rows = members.count()
    active = materialise(active, "active", rows=n_rows)
    share = F.col("own") / F.col("weight")
    first = active.groupBy("bucket").agg(F.min(F.struct(share.alias("share"), *carried)).alias("m"))
    chosen = materialise(as_centers(first.select("bucket", "m.*")), "centers", rows=n_rows)
    on, where = ["bucket", "node"], F.lit(True)
    centers_each, found = first_centers, []
    while True:
        links = tried(chosen, active, where)
        active = active.join(chosen.withColumnRenamed("center_node", "node").select(*on).distinct(), on, "left_anti")
        if not links.isEmpty():
            found.append(materialise(components(links, "ra", "rb"), "roots", rows=2 * links.count()))
            active = moved(active, found[-1])
        sizes = active.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("parts"))
        main = main.where("parts > 1").select("bucket", F.col("m.root").alias("main"))
        active = materialise(active.join(main, "bucket"), "active", rows=n_rows)
        n_rows = active.count()
        if not n_rows:
            return found
        order = Window.partitionBy("bucket").orderBy(share, "node")
        outside = active.where("root <> main").withColumn("k", F.row_number().over(order)).where(F.col("k") <= centers_each)
        chosen = materialise(as_centers(active.join(outside.select("node").distinct(), "node", "left_semi")), "centers", rows=n_rows)
        on, where = ["node"], first_shared
        active = active.drop("main")
        centers_each *= 8


def near_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    bands: int = 24,
    rows: int = 5,
    darts: int = 960,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_similarity: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: (id_col, version, class_id, class_version, class_size, kept), and if asked for the
    similarity of its text to that of the row of the class that stays, which may be below the threshold where only
    others link them.

    ``version`` is a hash of the text; (class_id, class_version) name the row of the class that stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows_in = small_batches(
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    )
    signed = signatures(rows_in, words, bands, rows, darts).withColumn("node", F.monotonically_increasing_id())
    signed = materialise(signed, "signatures")
    equal = ("one", "two", "weight")
    with_words = signed.where("weight > 0")
    nodes = with_words.groupBy(*equal).agg(F.min(F.struct("id", "version", "node", "bands")).alias("r"))
    nodes = materialise(nodes.select(*equal, "r.id", "r.version", "r.node", "r.bands"), "nodes")
    members = nodes.select("node", "weight", "id", "version", F.posexplode("bands").alias("band", "hash")).where("hash IS NOT NULL")
    members = members.withColumn("bucket", F.xxhash64("band", "hash"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(members.join(shared, "bucket").select("bucket", "band", "node", "weight", "id", "version"), "members")
    wanted = members.select("node", "id", "version").distinct()
    sets = rows_in.join(wanted, ["id", "version"]).select("node", "text")
    sets = materialise(multisets(sets, words).dropDuplicates(["node"]), "multisets")
    bounds = sets.drop("runs").join(own_runs(sets), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    bounds = bounds.join(nodes.select("node", "bands"), "node")
    bounded = members.select("bucket", "band", "node", "weight").join(bounds, "node")
    rooted = nodes.select(*equal, F.col("node").alias("set_node"), F.col("node").alias("root"))
    for mapping in merges(bounded, sets.select("node", "runs"), threshold):
        rooted = moved(rooted, mapping)
    placed = materialise(with_words.join(rooted, list(equal)).select("id", "version", "node", "set_node", "root"), "placed")
    alone = signed.where("weight = 0").select("id", "version", "node", F.col("node").alias("set_node"), F.col("node").alias("root"))
    placed = placed.unionByName(alone)
    best = placed.groupBy("root").agg(F.min(F.struct("id", "version", "node", "set_node")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    named = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    found = placed.join(best, "root")
    alike = F.lit(None).cast("double")
    if with_similarity:
        apart = F.col("set_node") != F.col("best.set_node")
        pairs = found.where(apart).select(F.col("set_node").alias("a"), F.col("best.set_node").alias("b")).distinct()
        found = found.join(similarities(pairs, sets).withColumnRenamed("a", "set_node"), "set_node", "left")
        alike = F.when(apart, F.col("similarity")).otherwise(F.lit(1.0))
    return found.select(
        named("id").alias(id_col),
        "version",
        named("best.id").alias("class_id"),
        F.col("best.version").alias("class_version"),
        "class_size",
        (F.col("node") == F.col("best.node")).alias("kept"),
        *([alike.alias("similarity")] if with_similarity else []),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns. Of rows repeated with their id and
    text all stay or go together."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col, **parameters)
    key_id, key_version, version = unused(docs, "_id", "_version", "_text_version")
    stay = classes.where("kept").select(F.col(id_col).alias(key_id), F.col("version").alias(key_version)).distinct()
    keyed = docs.withColumn(version, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key_id)) & (F.col(version) == F.col(key_version))
    return keyed.join(stay, same, "left_semi").drop(version)
