"""Near copies among vectors of one label: int8 tile products with rigorous error bounds.

Equal vectors of a label become one node. Nodes are cut into tiles of bounded size, and a tile is met by the nodes of
tiles before it. A pair is first judged by the product of int8 components: with u = s q + e, where q are whole numbers
from -127 to 127 and e is what rounding left, u.v differs from s_u s_v (q_u.q_v) by at most |s_u q_u| |e_v| + |e_u|.
Only pairs that this bound can't rule out are computed again in double precision. No pair leaves the task that found
it: it gives counts of links and the links that join parts not yet joined.

Few pivots, a bounded sample, save most of the meetings where the vectors have structure: a node meets only tiles within
whose radius a partner may be, and nodes so close to one pivot that any two of them are linked need no products at all,
so a group of near copies costs its size, not its square. Both follow from the triangle inequality of angles and lose
nothing. Vectors without structure leave all pairs of a label to compare, tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ship import ship_package
from quantloom.llm.common import materialise, tidy
from quantloom.llm.graph import components
from quantloom.llm.vectors import matrix, rows_of, usable

#: Bounds on angles and products are loosened by these, far above what floating point loses.
ANGLE_SLACK, PRODUCT_SLACK = 1e-6, 1e-5
#: Pairs computed in double precision at once, cells of a product at once.
PAIRS, CELLS = 1 << 14, 1 << 22
#: Tiles before a tile whose nodes meet it in one group.
TILES_TOGETHER = 8


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near one, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components (in floats, in which products of up to 1,040 of them are exact), scale and a bound on the length of
    what rounding left, for each row brought to length one."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.float32 if x.shape[1] <= 1040 else np.float64), scale.astype(q.dtype), error


class Tile:
    """Nodes of a tile, as rows of a matrix, and what they have met so far."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, threshold: float):
        self.nodes, self.weights, self.x, self.threshold = nodes, weights, scaled(x), threshold
        self.length = np.linalg.norm(self.x, axis=1)
        self.q, self.scale, self.error = quantised(self.x)
        self.links = np.zeros(len(nodes), np.int64)
        self.root = np.arange(len(nodes))

    def close(self, other: "Tile", begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (here, in ``other``) of the pairs with rows ``begin`` to ``end`` of ``other`` that are linked."""
        q = other.q[begin:end]
        estimate = (self.q @ q.T).astype(np.float32 if self.x.shape[1] <= 1040 else np.float64)
        estimate *= self.scale[:, None].astype(estimate.dtype)
        estimate *= other.scale[begin:end].astype(estimate.dtype)
        room = self.error[:, None] + (1 + self.error.max()) * other.error[None, begin:end] + PRODUCT_SLACK
        one, two = np.nonzero(estimate >= self.threshold - room)
        two += begin
        kept = [
            np.einsum("ij,ij->i", self.x[a], other.x[b]) / (self.length[a] * other.length[b]) >= self.threshold
            for a, b in ((one[k : k + PAIRS], two[k : k + PAIRS]) for k in range(0, len(one), PAIRS))
        ]
        kept = np.concatenate(kept) if kept else np.zeros(0, bool)
        return one[kept], two[kept]

    def meet(self, other: "Tile") -> list[tuple[int, int]]:
        """Count links with the nodes of ``other``, or within this tile if it is ``other``; the new joining links."""
        step, joins, own = max(CELLS // len(self.nodes), 1), [], other is self
        for begin in range(0, len(other.nodes), step):
            one, two = self.close(other, begin, begin + step)
            if own:
                one, two = one[one < two], two[one < two]
            self.links += np.bincount(one, other.weights[two], len(self.nodes)).astype(np.int64)
            other.links += np.bincount(two, self.weights[one], len(other.nodes)).astype(np.int64)
            joins += self.joined(other, one, two, own)
        return joins

    def joined(self, other: "Tile", one: np.ndarray, two: np.ndarray, own: bool) -> list[tuple[int, int]]:
        size = len(self.nodes)
        root = self.root.tolist() + ([] if own else list(range(size, size + len(other.nodes))))
        name = (lambda k: self.nodes[k]) if own else (lambda k: self.nodes[k] if k < size else other.nodes[k - size])

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        a, b = self.root[one], self.root[two] if own else size + two
        joins = []
        for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                joins.append((int(name(x)), int(name(y))))
                root[max(x, y)] = min(x, y)
        self.root = np.array(root[:size], dtype=np.int64)
        while not np.array_equal(self.root, shorter := self.root[self.root]):
            self.root = shorter
        return joins


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between the rows of ``x`` and pivots of length one."""
    x = scaled(x)
    return np.arccos(np.clip(x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True), -1.0, 1.0))


def chosen_pivots(nodes: DataFrame, n_nodes: int, threshold: float, most: int, per_pivot: int, bytes_most: int = 8 << 20) -> dict:
    """{(label, dim): unit vectors} of a sample of the nodes, the ``most`` with the smallest hashes or fewer where the
    table is small or vectors are long; of pivots closer than half the angle of a link only the first stays."""
    widest = nodes.agg(F.max("dim")).first()[0] or 1
    n = min(most, n_nodes // per_pivot, bytes_most // (8 * widest))
    near, found = math.acos(threshold) / 2, {}
    for r in nodes.orderBy(F.xxhash64("label", "vec"), "node").limit(n).collect() if n else []:
        x = scaled(np.array([r["vec"]], np.float64))
        x /= np.linalg.norm(x)
        there = found.setdefault((r["label"], r["dim"]), [])
        if not there or angles(x, np.concatenate(there)).min() > near:
            there.append(x)
    return {k: np.concatenate(v) for k, v in found.items()}


def runs(*columns: pa.Array) -> list[tuple[int, int]]:
    """(begin, end) of the stretches over which none of the columns changes."""
    n = len(columns[0])
    changed = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changed |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n] if n else [0]
    return list(zip(cuts, cuts[1:], strict=False))


def placed(nodes: DataFrame, pivots: dict, threshold: float) -> DataFrame:
    """``nodes`` with block, twice the number of the nearest pivot and one more for nodes that aren't within half the angle
    of a link of it (-1 where the label has no pivot), and their angle to the pivot."""
    near = math.acos(threshold) / 2 - ANGLE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            block, angle = np.full(len(labels), -1), np.full(len(labels), math.pi)
            for key in {k for k in zip(labels, dims, strict=True) if k in pivots}:
                rows = np.array([k for k, x in enumerate(zip(labels, dims, strict=True)) if x == key])
                to = angles(matrix(batch.column("vec").take(pa.array(rows)), np.float64), pivots[key])
                nearest = to.argmin(axis=1)
                angle[rows] = to[np.arange(len(rows)), nearest]
                block[rows] = 2 * nearest + (angle[rows] > near)
            yield batch.append_column("block", pa.array(block, pa.int32())).append_column("angle", pa.array(angle))

    return nodes.mapInArrow(tidy(run), nodes.limit(0).withColumns({"block": F.lit(0), "angle": F.lit(0.0)}).schema)


def dealt(numbered: DataFrame, pivots: dict, blocks: dict, threshold: float) -> DataFrame:
    """A row for each group (label, dim, tile, part) that a node takes part in: its own tile, with each group of tiles
    before it, and every later tile of the label whose radius lets it have a partner there.

    ``blocks``: {(label, dim): [(block, first tile, tiles, radius)]} of labels with pivots."""
    reach = math.acos(threshold) + ANGLE_SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            vec, own_block = batch.column("vec"), batch.column("block").to_pylist()
            tile, end = batch.column("tile").to_pylist(), batch.column("end").to_pylist()
            places: dict = {}
            for k, key in enumerate(keys):
                if key in pivots:
                    places.setdefault(key, []).append(k)
            to: dict[int, np.ndarray] = {}
            for key, rows in places.items():
                to |= zip(rows, angles(matrix(vec.take(pa.array(rows)), np.float64), pivots[key]), strict=True)
            row, at, part, role = [], [], [], []
            for k, key in enumerate(keys):
                mine, inner = tile[k], own_block[k] >= 0 and own_block[k] % 2 == 0
                for p in range(mine // TILES_TOGETHER + 1):
                    row.append(k), at.append(mine), part.append(p), role.append(0)
                later = [] if inner else list(range(mine + 1, end[k]))
                for block, first, tiles, radius in blocks.get(key, ()):
                    if block > own_block[k] and to[k][block // 2] <= radius + reach:
                        later += range(first, first + tiles)
                for t in later:
                    row.append(k), at.append(t), part.append(mine // TILES_TOGETHER), role.append(1)
                if len(row) >= 4096:
                    yield from rows_out(batch, row, at, part, role)
                    row, at, part, role = [], [], [], []
            yield from rows_out(batch, row, at, part, role)

    def rows_out(batch: pa.RecordBatch, row: list, at: list, part: list, role: list) -> Iterator[pa.RecordBatch]:
        if row:
            out = batch.select(["label", "dim", "node", "weight", "block", "vec"]).take(pa.array(row))
            for name, values in (("at", at), ("part", part), ("role", role)):
                out = out.append_column(name, pa.array(values, pa.int32()))
            yield out

    kept = numbered.select("label", "dim", "node", "weight", "block", "vec").limit(0)
    return numbered.mapInArrow(tidy(run), kept.withColumns({c: F.lit(0) for c in ("at", "part", "role")}).schema)


def met(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): nodes a and their numbers of links n (b null), and links (a, b) that join parts, of each group."""
    ordered = groups.repartition("label", "dim", "at", "part").sortWithinPartitions("label", "dim", "at", "part", "role", "node")

    def counts(tile: Tile) -> pa.RecordBatch:
        some = tile.links > 0
        nodes = pa.array(tile.nodes[some])
        return pa.RecordBatch.from_arrays([nodes, pa.nulls(len(nodes), pa.int64()), pa.array(tile.links[some])], ["a", "b", "n"])

    def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = ([p[k] for p in pairs] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, tile = None, [], None

        def settled() -> Iterator[pa.RecordBatch]:
            """The tile of the rows that wait; where it meets itself, what comes of that."""
            nonlocal tile
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            tile = as_tile(rows)
            waiting.clear()
            block = rows.column("block")[0].as_py()
            if key[3] == key[2] // TILES_TOGETHER and (block < 0 or block % 2):
                yield links(tile.meet(tile))

        def as_tile(rows: pa.RecordBatch) -> Tile:
            node, weight = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight"))
            return Tile(node, weight, matrix(rows.column("vec"), np.float64), threshold)

        for batch in batches:
            for begin, end in runs(*(batch.column(c) for c in ("label", "dim", "at", "part", "role"))):
                rows = batch.slice(begin, end - begin)
                now = tuple(rows.column(c)[0].as_py() for c in ("label", "dim", "at", "part"))
                if now != key:
                    if waiting:
                        yield from settled()
                    if tile is not None:
                        yield counts(tile)
                    key, tile = now, None
                if rows.column("role")[0].as_py() == 0:
                    waiting.append(rows)
                    continue
                if waiting:
                    yield from settled()
                if tile is None:  # no node was dealt to this tile
                    continue
                visitors = as_tile(rows)
                yield links(tile.meet(visitors))
                yield counts(visitors)
        if waiting:
            yield from settled()
        if tile is not None:
            yield counts(tile)

    return ordered.mapInArrow(tidy(run), "a long, b long, n long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
    most_pivots: int = 2048,
    nodes_per_pivot: int = 2048,
    tile_rows: tuple[int, int] = (1024, 32_768),
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row: how many other rows of its label have a cosine of at least
    ``threshold`` (above 0) with it, and the smallest id that links reach.

    A tile has a 64th of the nodes, within ``tile_rows``; one pivot for ``nodes_per_pivot`` nodes, at most
    ``most_pivots``, are sampled.

    Defined results: a row without label, or whose vector is null, zero, empty or has null or non-finite components, has
    no links and is its own component; so is each such row of several with one id. Vectors of different lengths are
    never linked. Rows that repeat an id are rows like any others: equal ones are linked with each other. Null ids are
    passed over when the smallest id is sought; a component of null ids alone has a null id and is kept. An empty table
    gives an empty one. Other columns don't matter, whatever their names."""
    ship_package(vectors.sparkSession)
    rows = rows_of(vectors, id_col, label_col, vec_col)
    fit = usable(F.col("vec")) & F.col("label").isNotNull()
    fit = fit & F.exists("vec", lambda x: x != 0)
    # a positive zero for each negative one, so that equal vectors are equal
    plain = F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))
    rows = rows.select("id", "label", F.when(F.coalesce(fit, F.lit(False)), plain).alias("vec"))
    some = rows.where("vec IS NOT NULL")
    nodes = some.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    nodes = nodes.select("label", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("node"), "least", "weight", "vec")
    nodes = materialise(nodes, "nodes")
    n_nodes = nodes.count()
    pivots = chosen_pivots(nodes, n_nodes, threshold, most_pivots, nodes_per_pivot)
    at = materialise(placed(nodes, pivots, threshold), "placed")

    of_tile = min(max(n_nodes // 64, tile_rows[0]), tile_rows[1])
    group = ["label", "dim"]
    stats = at.groupBy(*group, "block").agg(
        F.ceil(F.count(F.lit(1)) / of_tile).cast("int").alias("tiles"),
        F.max("angle").alias("radius"),
        F.min("node").alias("first_node"),
        F.sum("weight").alias("block_weight"),
    )
    until = F.sum("tiles").over(Window.partitionBy(*group).orderBy("block")).cast("int")
    stats = materialise(stats.withColumn("end", until).withColumn("first", F.col("end") - F.col("tiles")), "blocks")
    # at most two blocks a pivot
    blocks: dict = {}
    for r in stats.where("block >= 0").orderBy("block").collect():
        blocks.setdefault((r["label"], r["dim"]), []).append((r["block"], r["first"], r["tiles"], r["radius"]))

    tile = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("tiles"))).cast("int")
    numbered = at.join(stats, [*group, "block"]).withColumn("tile", tile)
    found = materialise(met(dealt(numbered, pivots, blocks, threshold), threshold), "met")

    inner = (F.col("block") >= 0) & (F.col("block") % 2 == 0)
    joins = numbered.where(inner & (F.col("node") != F.col("first_node"))).select(F.col("node").alias("a"), F.col("first_node").alias("b"))
    roots = components(joins.unionByName(found.where("b IS NOT NULL").select("a", "b")))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = F.when(inner, F.col("block_weight")).otherwise(F.col("weight")) - 1
    linked = numbered.select("label", "vec", "node", "least", own.alias("own")).join(counted, "node", "left").join(roots, "node", "left")
    linked = linked.withColumn("root", F.coalesce("root", "node"))
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(named, "root").select("label", "vec", (F.col("own") + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    alone = F.col("vec").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return rows.join(linked, ["label", "vec"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
