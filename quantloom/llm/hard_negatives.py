"""Hard negatives by a dual-tree search.

Anchors are taken in blocks of bounded size. A block's anchors make a tree of balls for each label, which goes to every
task with the block; a task makes a tree of balls of each batch of candidates. Pairs of nodes go down both trees together:
the inner products of all anchors and candidates below a pair lie within c.d -+ (|c| s + |d| r + r s), where c, d are
the centres and r, s the radii, so a pair whose interval can't give any of its anchors a better row is dropped with all
below it. Leaf pairs that remain are scored exactly, in numbers that hold every integer that may come up: each leaf of
anchors meets its highest bounds first, so that what they find drops others. What the anchors of a block are to each
other makes the first, already valid, limits.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ship import ship_package
from quantloom.llm.common import materialise, tidy
from quantloom.llm.vectors import matrix, numbers, rows_of, usable, whole_numbers

#: Rows of a leaf of the anchors' and of the candidates' trees; leaves that a leaf of anchors meets, at most, before bounds are
#: looked at again.
ANCHOR_LEAF, CANDIDATE_LEAF, LEAVES = 32, 128, 64
#: Below every score, above every score.
LEAST, MOST = -(2**62), 2**62


class Balls:
    """Binary trees of balls, one for each label, over rows of integers: nodes are ranges of ``order``, children of node k
    are ``child[k]`` and the one after it, leaves have none (-1)."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        self.order = np.lexsort((np.arange(len(x)), labels))
        self.begin, self.end, self.child, self.label = [], [], [], []
        cuts = [0, *(np.flatnonzero(np.diff(labels[self.order])) + 1).tolist(), len(x)] if len(x) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.node(a, b, labels[self.order[a]])
        self.n_roots = len(self.begin)
        center, radius, k = [], [], 0
        floats = x.astype(np.float64)
        while k < len(self.begin):
            a, b = self.begin[k], self.end[k]
            of = floats[self.order[a:b]]
            middle = of.mean(axis=0)
            away = np.linalg.norm(of - middle, axis=1)
            center.append(middle)
            radius.append(away.max() * (1 + 1e-9) + 1e-6)
            if b - a > leaf and radius[-1] > 1e-5:
                self.child[k] = len(self.begin)
                # rows nearer to the one farthest from the centre, and the rest
                poles = of[away.argmax()]
                side = np.linalg.norm(of - poles, axis=1)
                ranked = np.argsort(side, kind="stable")
                self.order[a:b] = self.order[a:b][ranked]
                half = (b - a) // 2
                self.node(a, a + half, self.label[k])
                self.node(a + half, b, self.label[k])
            k += 1
        self.center = np.array(center).reshape(len(center), x.shape[1])
        self.radius = np.array(radius)
        self.length = np.linalg.norm(self.center, axis=1)
        self.begin, self.end, self.child, self.label = (np.array(v, np.int64) for v in (self.begin, self.end, self.child, self.label))
        self.x = x[self.order]
        self.longest = float(np.linalg.norm(self.x.astype(np.float64), axis=1).max(initial=0))
        self.held = {}

    def of_type(self, kind: type) -> np.ndarray:
        """The rows in tree order as numbers of a type."""
        if kind not in self.held:
            self.held[kind] = self.x.astype(kind)
        return self.held[kind]

    def node(self, begin: int, end: int, label: int) -> None:
        for column, value in ((self.begin, begin), (self.end, end), (self.child, -1), (self.label, label)):
            column.append(value)

    def over(self, values: np.ndarray, reduce: np.ufunc) -> np.ndarray:
        """``reduce`` of the values of the rows (in tree order) below each node, children before their parents."""
        out = np.array([0] * len(self.begin), values.dtype)
        leaves = self.child < 0
        for k in np.flatnonzero(leaves):
            out[k] = reduce.reduce(values[self.begin[k] : self.end[k]])
        for k in np.flatnonzero(~leaves)[::-1]:
            out[k] = reduce(out[self.child[k]], out[self.child[k] + 1])
        return out


def interval(a: Balls, i: np.ndarray, b: Balls, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of the rows below the nodes i of ``a`` and j of ``b``."""
    middle = (a.center @ b.center.T)[i, j]
    away = a.length[i] * b.radius[j] + b.length[j] * a.radius[i] + a.radius[i] * b.radius[j]
    away += 1e-9 * (a.length[i] * b.length[j] + away) + 1e-3
    return middle - away, middle + away


def leaf_pairs(a: Balls, b: Balls, same: bool, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor leaves, candidate leaves) whose labels are the ``same`` or differ and which ``wanted`` keeps, by anchor leaf, in
    portions: 1, 2, 4, ... leaves for each, its highest upper bounds first; ``wanted(nodes, lower, upper)`` is asked again
    before each portion."""
    i, j = (g.ravel() for g in np.meshgrid(np.arange(a.n_roots), np.arange(b.n_roots), indexing="ij"))
    fit = (a.label[i] == b.label[j]) == same
    i, j, leaves = i[fit], j[fit], []
    while len(i):
        low, high = interval(a, i, b, j)
        kept = wanted(i, low, high)
        i, j, low, high = i[kept], j[kept], low[kept], high[kept]
        done = (a.child[i] < 0) & (b.child[j] < 0)
        leaves.append((i[done], j[done], low[done], high[done]))
        i, j = i[~done], j[~done]
        for tree, one in ((a, 0), (b, 1)):
            node = (i, j)[one]
            inner = tree.child[node] >= 0
            first = np.where(inner, tree.child[node], node)
            pair = [np.concatenate([x, x[inner]]) for x in (i, j)]
            pair[one] = np.concatenate([first, first[inner] + 1])
            i, j = pair
    if not leaves:
        return
    i, j, low, high = (np.concatenate(v) for v in zip(*leaves, strict=True))
    ranked = np.lexsort((-high, i))
    i, j, low, high = i[ranked], j[ranked], low[ranked], high[ranked]
    place = places(i)
    k, portion = 0, 1
    while len(i):
        now = place < k + portion
        k, portion = k + portion, min(2 * portion, LEAVES)
        some = now & wanted(i, low, high)
        if some.any():
            yield i[some], j[some]
        i, j, low, high, place = (v[~now] for v in (i, j, low, high, place))


def places(group: np.ndarray) -> np.ndarray:
    """The place of each element among those of its group, whose elements lie together."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))


class Best:
    """The ``k`` best (score, then smaller id) of each of ``n`` slots, and the score that a further one must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, LEAST, np.int64)
        self.forget()

    def forget(self) -> None:
        """Drop the rows, keep the limits that they set."""
        self.score = np.full((len(self.limit), self.k), LEAST, np.int64)
        self.id, self.row = (np.full(self.score.shape, MOST, np.int64) for _ in range(2))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Only the slots that have new rows are read and written."""
        if not len(slot):
            return
        touched, new = np.unique(slot, return_inverse=True)
        both = np.concatenate([np.repeat(np.arange(len(touched)), self.k), new])
        score, ids, row = (np.concatenate([held[touched].ravel(), v]) for held, v in ((self.score, score), (self.id, ids), (self.row, row)))
        ranked = np.lexsort((row, ids, -score, both))
        ranked = ranked[places(both[ranked]) < self.k].reshape(-1, self.k)  # no slot has fewer, as empty ones count
        self.score[touched], self.id[touched], self.row[touched] = score[ranked], ids[ranked], row[ranked]
        self.limit[touched] = np.maximum(self.limit[touched], self.score[touched, -1])

    def found(self) -> list[np.ndarray]:
        """slot, score, id and row of what is there."""
        slot, place = np.nonzero(self.score > LEAST)
        return [slot, self.score[slot, place], self.id[slot, place], self.row[slot, place]]


class Anchors:
    """A block of anchors in tree order: ids, rows, labels, integers; with their positives where these are known."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.tree = Balls(x, labels, ANCHOR_LEAF)
        order = self.tree.order
        self.ids, self.rows, self.labels = ids[order], rows[order], labels[order]

    def pairs(self, batch: Balls, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, candidates in tree order, scores) of leaf pairs that lie together by anchor leaf, a leaf of anchors with
        all its partners at once. No sum of products is longer than the two vectors, so scores are exact."""
        largest = (self.tree.longest + 1) * (batch.longest + 1)
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
        x, y = self.tree.of_type(kind), batch.of_type(kind)
        starts = np.flatnonzero(places(i) == 0)
        for a, b in zip(starts, np.r_[starts[1:], len(i)], strict=True):
            begin, end = self.tree.begin[i[a]], self.tree.end[i[a]]
            of = np.concatenate([np.arange(batch.begin[k], batch.end[k]) for k in j[a:b]])
            yield np.arange(begin, end), of, x[begin:end] @ y[of].T


class Positives:
    """Search of the first ``k`` other rows of the label of each anchor."""

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.best = anchors, Best(len(anchors.ids), k)

    def search(self, batch: Balls, ids: np.ndarray, rows: np.ndarray) -> None:
        best, anchors = self.best, self.anchors

        def wanted(nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= self.floor[nodes]

        self.refresh()
        for i, j in leaf_pairs(anchors.tree, batch, True, wanted):
            for at, of, score in anchors.pairs(batch, i, j):
                a, c = np.nonzero(score >= best.limit[at].astype(score.dtype)[:, None])
                row = rows[batch.order[of[c]]]
                other = row != anchors.rows[at[a]]
                a, c, row = a[other], c[other], row[other]
                best.add(at[a], score[a, c].astype(np.int64), ids[batch.order[of[c]]], row)
            self.refresh()

    def refresh(self) -> None:
        self.floor = self.anchors.tree.over(self.best.limit, np.minimum)


class Negatives:
    """Search of the first ``k`` rows of other labels within the band of each anchor and positive. A slot is one of the
    up to ``per`` positives of an anchor; slots without one have an empty band."""

    def __init__(self, anchors: Anchors, least: np.ndarray, most: np.ndarray, k: int):
        self.anchors, self.least, self.most = anchors, least, most  # anchors x per
        self.best = Best(least.size, k)

    def search(self, batch: Balls, ids: np.ndarray, rows: np.ndarray) -> None:
        best, anchors, per = self.best, self.anchors, self.least.shape[1]
        top = anchors.tree.over(self.most.max(axis=1), np.maximum)

        def wanted(nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return (high >= self.floor[nodes]) & (low <= top[nodes])

        self.refresh()
        for i, j in leaf_pairs(anchors.tree, batch, False, wanted):
            for at, of, score in anchors.pairs(batch, i, j):
                need, most = self.need(at), self.most[at]
                low, high = (v.astype(score.dtype)[:, None] for v in (need.min(axis=1), most.max(axis=1)))
                a, c = np.nonzero((score >= low) & (score <= high))
                value = score[a, c].astype(np.int64)
                k, p = np.nonzero((value[:, None] >= need[a]) & (value[:, None] <= most[a]))
                row = batch.order[of[c[k]]]
                best.add(at[a[k]] * per + p, value[k], ids[row], rows[row])
            self.refresh()

    def need(self, at: np.ndarray | slice) -> np.ndarray:
        """The score from which on a row counts for each positive of anchors."""
        return np.maximum(self.least[at], self.best.limit.reshape(self.least.shape)[at])

    def refresh(self) -> None:
        self.floor = self.anchors.tree.over(self.need(slice(None)).min(axis=1), np.minimum)


def searched(candidates: DataFrame, start: Positives | Negatives) -> DataFrame:
    """(slot, score, id, row): what each task found for the slots of ``start``, at most k of each."""
    start.best.forget()  # the table has these rows too
    session = candidates.sparkSession
    shared = session.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = copy.deepcopy(shared.value)  # tasks of one worker share the broadcast
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), np.int64)
                ids, rows, labels = (numbers(batch.column(c)) for c in ("id", "row", "class"))
                search.search(Balls(x, labels, CANDIDATE_LEAF), ids, rows)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in search.best.found()], ["slot", "score", "id", "row"])

    return candidates.mapInArrow(tidy(run), "slot long, score long, id long, row long")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each slot."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    n_positives: int = 5,
    n_negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    anchor_modulus: int = 100,
    scale: int = 256,
    block_rows: int = 16_384,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``n_positives`` other rows of the same label the first ``n_negatives`` rows of other labels whose score lies within
    ``band`` per cent of the positive's. Scores are inner products of the integers floor(``scale`` * x); higher ones come
    first, ties by smaller id. Anchors are the rows whose id is divisible by ``anchor_modulus``.

    The query set goes through the table in blocks of ``block_rows`` anchors, each of which is held by the driver and sent
    to tasks (12 MB for 64 components).

    Defined results: rows with a null label, a null vector or any null or non-finite component take no part; vectors of
    different lengths are never scored; rows with a null id are no anchors and come last among ties, with a null id in the
    result; rows that repeat an id are rows like any others, ties among them by an arbitrary but fixed order; an empty table
    gives an empty one; a component beyond 2**24 / ``scale`` is an error, as scores don't fit in a long. Other columns don't
    matter, whatever their names."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = rows_of(vectors, id_col, label_col, vec_col).where(usable(F.col("vec")) & F.col("label").isNotNull())
    rows = rows.select("id", "label", whole_numbers(F.col("vec"), scale).alias("vec"), F.size("vec").alias("dim"))
    # dealt out evenly, as each row meets all anchors, however few files the table has
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows.repartition(spark.sparkContext.defaultParallelism, "row"), "vectors")
    if dict(rows.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("class", F.col("label").cast("long"))
    else:
        names = materialise(rows.select("label").distinct().withColumn("class", F.monotonically_increasing_id()), "labels")
        rows = rows.join(names, "label")
    anchors = rows.where(F.col("id") % anchor_modulus == 0)
    blocks = anchors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("n")).orderBy("dim").collect()
    parts = []
    for dim, n in ((r["dim"], r["n"]) for r in blocks):
        of_dim = rows.where(F.col("dim") == dim)
        for k in range(n):
            mine = anchors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(n)) == k))
            parts.append(one_block(of_dim, mine, n_positives, n_negatives, band, f"negatives{len(parts)}"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def one_block(rows: DataFrame, mine: DataFrame, n_positives: int, n_negatives: int, band: tuple[int, int], name: str) -> DataFrame:
    spark = rows.sparkSession
    batch = mine.select("id", "row", "class", "vec").orderBy("row").toArrow().combine_chunks()
    x = matrix(batch.column("vec").combine_chunks(), np.int64)
    ids, own, classes = (numbers(batch.column(c).combine_chunks()) for c in ("id", "row", "class"))
    anchors = Anchors(ids, own, classes, x)
    among = Balls(x, classes, CANDIDATE_LEAF)

    search = Positives(anchors, n_positives)
    search.search(among, ids, own)
    positives = first_of(searched(rows, search), n_positives).select("slot", "score", "id", "rank").collect()
    least, most = np.full((len(ids), n_positives), MOST), np.full((len(ids), n_positives), LEAST)
    for r in positives:
        # least whole score from band[0] per cent on, largest up to band[1] per cent
        least[r["slot"], r["rank"] - 1] = -((-band[0] * r["score"]) // 100)
        most[r["slot"], r["rank"] - 1] = (band[1] * r["score"]) // 100
    search = Negatives(anchors, least, most, n_negatives)
    search.search(among, ids, own)
    found = first_of(searched(rows, search), n_negatives)

    pairs = [(r["slot"] * n_positives + r["rank"] - 1, int(anchors.ids[r["slot"]]), r["id"], r["score"]) for r in positives]
    named = spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long")
    real = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c))
    out = found.join(F.broadcast(named), "slot").select(
        "anchor_id", real("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
    return materialise(out, name)
