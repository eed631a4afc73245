"""Removal of later copies of passages by longest previous factors.

A byte goes if a ``width``-byte string that covers it also starts earlier (smaller id, or earlier in the same
document). With all suffixes of all documents in lexicographic order, the longest previous
factor of a suffix is what it shares with the suffix of the previous or the next smaller position around it; the byte
string at a position goes if that factor has ``width`` bytes or more. The distributed form sorts few of the suffixes:

1. Anchors. Every window of ``width`` bytes names the smallest-hashed ``seed`` bytes in it. The name depends on the
   window's bytes alone, so equal windows name equal seeds at equal offsets; neighbouring windows share theirs, and one
   row stands for some 35 windows. Its context is all bytes that these windows cover.
2. Sparse order. Of the suffixes that begin at an anchor's first window, those with equal contexts are neighbours; all but
   the one of the smallest position have a previous smaller neighbour that agrees on the whole context, so all their
   windows are later copies. Contexts are told apart by 128 bits from two independent hashes (seed and context). The first
   rows of contexts whose seed has a second context may still share some of their windows, and go on with their bytes.
3. Suffix order. Rows go on by seed, and a task sorts the suffixes of whole seeds by their bytes, takes the shared lengths
   of neighbours, finds previous and next smaller positions and from both the longest previous factors. Rows of
   seeds with more than ``most_rows`` rows go on in slices of ``SLICE`` neighbouring windows, by the bytes that all windows
   of a slice share, which tells most of them apart. Where even these are the same in more rows, single suffixes are put in
   order over all tasks, by ranges of bytes and position, so that equal ones are dealt out too; all but the smallest
   position of equal ones are later copies.
4. Each document's copied windows become byte spans, and the bytes left are joined.

Seeds that a sample of the documents shows in more than one of ``hot_share`` documents are dealt out by context in step 2;
this changes the placement only. Among the rows of a batch only the smallest position of a context is sent on, the
others are settled there, so a long passage that a third of all documents share sends few rows.

Defined results: null text is empty; null ids come first, as the smallest id there is (-2**63, which no row may have
beside them); texts below ``width`` bytes lose nothing; rows repeated
with their id and text count as one document and get equal results; rows that share an id but not the text are
ordered by a hash of the text; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import materialise, small_batches, tidy, unused
from quantloom.llm.hashing import Prefixes, U, mix, sliding_min

CHUNK = 1 << 17
LOW = U(CHUNK * 2 - 1)
SLICE = 8


def anchors(text: bytes, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(seed hash, context hash, first window, number of windows, place of the seed after the first window) of each anchor;
    long texts in chunks of windows."""
    found = []
    for base in range(0, max(len(text) - width + 1, 0), CHUNK):
        data = np.frombuffer(text, np.uint8)[base : base + CHUNK + width - 1]
        seeds = Prefixes(data).windows(seed)
        least = sliding_min((seeds & ~LOW) | np.arange(len(seeds), dtype=np.uint64), width - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        n = np.diff(np.append(first, len(least)))
        at = (least[first] & LOW).astype(np.int64)
        shift = at - first
        shape = shift.astype(np.uint64) << U(32) | n.astype(np.uint64)
        context = mix(Prefixes(data, 1).of(first, first + n - 1 + width) ^ mix(shape))
        found.append((seeds[at], context, first + base, n, shift))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else ()


def settle(keys: list[np.ndarray], position: list[np.ndarray]) -> np.ndarray:
    """Rows that have a row of equal keys and smaller position among them."""
    order = np.lexsort([*position[::-1], *keys[::-1]])
    later = np.zeros(len(order), bool)
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    moved = np.zeros(len(same), bool)  # the same position again isn't a copy
    for x in position:
        moved |= x[order[1:]] != x[order[:-1]]
    run = np.cumsum(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    fresh = np.concatenate([[True], moved | ~same]) if len(order) else np.zeros(0, bool)
    rank = np.cumsum(fresh)
    first_rank = np.zeros(run[-1] + 1 if len(run) else 0, np.int64)
    first_rank[run[::-1]] = rank[::-1]
    later[order] = rank > first_rank[run] if len(order) else False
    return later


def column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def hot_seeds(texts: DataFrame, width: int, seed: int, one_in: int, hot_share: int, most: int = 50_000) -> np.ndarray:
    """Hashes of the seeds that at least one of ``hot_share`` sampled documents has, the ``most`` commonest of them. A
    document has a bounded number of anchors on average, so the list doesn't grow with the corpus."""
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(x[0]) for t in batch.column("text").to_pylist() if (x := anchors(t.encode(), width, seed))]
            yield pa.RecordBatch.from_arrays([column(np.concatenate([np.zeros(1, np.uint64), *found]))], ["seed"])

    counted = sample.mapInArrow(tidy(run), "seed long").groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    least = max(sample.count() // hot_share, 32)
    rows = counted.where((F.col("n") >= least) & (F.col("seed") != 0)).orderBy(F.desc("n")).limit(most).collect()
    return np.sort(np.array([r["seed"] for r in rows], np.int64).view(np.uint64))


def anchor_rows(texts: DataFrame, width: int, seed: int, hot: np.ndarray, parts: int = 1024) -> DataFrame:
    """The anchors of all texts. ``seed`` is what gathers them: of hot seeds also a part of the contexts, of rows that are
    settled in their batch anything."""
    known = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors((x or "").encode(), width, seed) for x in batch.column("text").to_pylist()]
            sizes = [len(p[0]) if p else 0 for p in found]
            if not sum(sizes):
                continue
            hashes, context, start, n, shift = (np.concatenate([p[k] for p in found if p]) for k in range(5))
            at = np.repeat(np.arange(len(found)), sizes)
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("id", "version"))
            copied = settle([hashes, context], [ids, versions, start])
            dealt = np.isin(hashes, known.value)
            hashes = np.where(dealt, mix(hashes + context % U(parts)), hashes)
            hashes = np.where(copied, mix(context ^ ids.astype(np.uint64) ^ start.astype(np.uint64)), hashes)
            yield pa.RecordBatch.from_arrays(
                [column(hashes), column(context), column(ids), column(versions), pa.array(start.astype(np.int32)), pa.array((shift << 16 | n).astype(np.int32)), pa.array(copied), pa.array(dealt)],
                ["seed", "context", "id", "version", "start", "shape", "copied", "hot"],
            )

    return texts.mapInArrow(tidy(run), "seed long, context long, id long, version int, start int, shape int, copied boolean, hot boolean")


def slices(data: bytes, first: int, n: int, shift: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, first window, bytes) of the slices of an anchor's windows. Slices count from the seed, so equal windows are in
    slices of equal number; the key is a hash of what all windows of a slice share."""
    seed = first + shift
    for k in range((shift - n + 1) // SLICE, shift // SLICE + 1):
        nearest, farthest = max(SLICE * k, shift - n + 1), min(SLICE * k + SLICE - 1, shift)
        shared = data[seed - SLICE * k : seed - SLICE * k - SLICE + 1 + width]
        key = int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True)
        yield key, seed - farthest, data[seed - farthest : seed - nearest + width]


def open_bytes(texts: DataFrame, width: int) -> DataFrame:
    """(seed, id, version, start, bytes, sliced) of the rows of each text: the bytes of a row's windows, or, of rows without a
    seed, those of their slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "version", "packed", "rows"))
            for key, version, packed, rows in zip(*columns, strict=True):
                data, found = unpack(packed), []
                for r in rows:
                    first, n = r["start"], r["n"]
                    if r["seed"] is None:
                        found += [(*x, True) for x in slices(data, first, n, r["shift"], width)]
                    else:
                        found.append((r["seed"], first, data[first : first + n - 1 + width], False))
                seeds, starts, parts, sliced = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seeds, pa.int64()), pa.array([key] * len(seeds), pa.int64()), pa.array([version] * len(seeds), pa.int32()), pa.array(starts, pa.int32()), pa.array(parts, pa.binary()), pa.array(sliced)],
                    ["seed", "id", "version", "start", "bytes", "sliced"],
                )

    return texts.mapInArrow(tidy(run), "seed long, id long, version int, start int, bytes binary, sliced boolean")


def smaller_before(rank: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order the nearest earlier place of smaller rank, or -1, and the least of ``shared`` (with the place
    before) on the way there."""
    at, least = np.arange(len(rank)) - 1, shared.copy()
    todo = np.flatnonzero((at >= 0) & (rank[at] >= rank))
    while len(todo):
        to = at[todo]
        least[todo], at[todo] = np.minimum(least[todo], least[to]), at[to]
        todo = todo[(at[todo] >= 0) & (rank[at[todo]] >= rank[todo])]
    return at, np.where(at >= 0, least, 0)


def previous_factors(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, up to the width of ``windows`` (its first bytes, a row each): what it shares
    with the previous or the next smaller position in suffix order. ``position`` ascends; equal ones are the same place."""
    width = windows.shape[1]
    order = np.argsort(windows.view(f"S{width}").ravel(), kind="stable")
    placed, rank = windows[order], position[order]
    differs = placed[1:] != placed[:-1]
    shared = np.zeros(len(order) + 1, np.int64)
    shared[1:-1] = np.where(differs.any(1), differs.argmax(1), width)
    _, before = smaller_before(rank, shared[:-1])
    _, after = smaller_before(rank[::-1], shared[1:][::-1])
    factors = np.empty(len(order), np.int64)
    factors[order] = np.maximum(before, after[::-1])
    return factors


def later_runs(rows: list[np.ndarray], texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(row, first window, how many) of the runs of windows with a previous factor of ``width`` bytes. ``rows`` are ids,
    versions and starts of ``texts``, all rows of some seeds."""
    ids, versions, starts = rows
    order = np.lexsort([starts, versions, ids])
    n = np.array([len(texts[k]) for k in order]) - width + 1
    data = np.frombuffer(b"".join([texts[k] for k in order]), np.uint8)
    row = np.repeat(np.arange(len(order)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(n + width - 1) - (n + width - 1), n) + within
    first = starts[order][row] + within
    # windows of one document may be in rows that overlap, so positions are sorted as such
    by_position = np.lexsort([first, versions[order][row], ids[order][row]])
    keys = [x[by_position] for x in (ids[order][row], versions[order][row], first)]
    moved = np.zeros(len(row), bool)
    for key in keys:
        moved[1:] |= key[1:] != key[:-1]
    windows = np.lib.stride_tricks.sliding_window_view(data, width)[at[by_position]]
    copied = np.zeros(len(row), bool)
    copied[by_position] = previous_factors(windows, np.cumsum(moved)) >= width
    edge = np.flatnonzero(np.concatenate([[True], (copied[1:] != copied[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(edge, len(copied)))
    edge, size = edge[copied[edge]], size[copied[edge]]
    return order[row[edge]], first[edge], size


def suffix_runs(rows: DataFrame, width: int, at_once: int = 1 << 19) -> DataFrame:
    """(id, version, start, n) of the later copies among ``rows`` (seed, id, version, start, bytes), which come sorted by
    seed: whole seeds of together about ``at_once`` bytes are sorted at once."""

    def settled(held: list[tuple]) -> pa.RecordBatch:
        _, ids, versions, starts, texts = zip(*held, strict=True)
        keys = [np.array(x, np.int64) for x in (ids, versions, starts)]
        row, first, n = later_runs(keys, list(texts), width)
        columns = [pa.array(keys[0][row]), pa.array(keys[1][row].astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["id", "version", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seed", "id", "version", "start", "bytes")), strict=True):
                if size >= at_once and row[0] != held[-1][0]:
                    yield settled(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settled(held)

    return rows.mapInArrow(tidy(run), "id long, version int, start int, n int")


ORDER = ("bytes", "id", "version", "start")


def later_suffixes(rows: DataFrame) -> DataFrame:
    """(id, version, start) of the ``rows`` (id, version, start, bytes) with equal bytes at a smaller position.

    The rows lie in order over all tasks. A row's place says what it is, but for the rows of a task that may go on with the
    bytes of the task before: these few wait for the ends of all tasks."""
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = run_of = run_from = None
        for batch in batches:
            found = []
            for data, *position in zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True):
                if data != run_of:
                    run_of, run_from = data, position
                    begin = begin or (data, position)
                if position != run_from:
                    found.append((*position, "later", None))
                elif (data, position) == begin:
                    found.append((*position, "first", data))
            yield rows_of(found)
        if begin:
            yield rows_of([(*run_from, "end", run_of)])

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
        columns = zip(*found, strict=True) if found else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "version", "start", "place", "bytes"])

    position = ("id", "version", "start")
    told = materialise(small_batches(ordered).mapInArrow(tidy(run), "id long, version int, start int, place string, bytes binary"), "ordered")
    ends = told.where("place = 'end'").groupBy("bytes").agg(F.min(F.struct(*position)).alias("least"))
    waiting = told.where("place = 'first'").join(ends, "bytes").where(F.struct(*position) > F.col("least"))
    return told.where("place = 'later'").select(*position).unionByName(waiting.select(*position))


def follows(keys: tuple[str, ...], order) -> Column:
    """Whether the row before this one in its partition has equal keys."""
    same = F.lit(True)
    for key in keys:
        same = same & (F.lag(key).over(order) == F.col(key))
    return F.coalesce(same, F.lit(False))


def copied_windows(
    texts: DataFrame, placed: DataFrame, width: int, seed: int, most_rows: int = 4096, one_in: int = 64, hot_share: int = 1000
) -> DataFrame:
    """(id, version, start, n): runs of windows that start earlier too. ``placed`` has the packed texts by (id, version)."""
    in_seed = Window.partitionBy("seed").orderBy("context", "id", "version", "start")
    whole = in_seed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    position = ("id", "version", "start")
    ordered = (
        anchor_rows(texts, width, seed, hot_seeds(texts, width, seed, one_in, hot_share))
        .withColumn("_same", follows(("context",), in_seed))
        .withColumn("_again", follows(("context", *position), in_seed))
        .withColumn("_other", F.col("hot") | (F.min("context").over(whole) != F.max("context").over(whole)))
        .withColumn("_many", F.col("hot") | (F.count(F.lit(1)).over(whole) > most_rows))
    )
    # a repeat of the very same position belongs to a repeated row; it is a copy only if the row it repeats is one,
    # and as such rows get equal results it says nothing of its own
    settled = ordered.where("NOT _again").withColumn("whole", F.col("copied") | F.col("_same")).where("whole OR _other")
    gathered = F.when(~F.col("whole") & ~F.col("_many"), F.col("seed"))
    settled = settled.select(*position, F.expr("shape & 65535").alias("n"), F.expr("shape >> 16").alias("shift"), "whole", gathered.alias("seed"))
    settled = materialise(settled, "anchors")
    row = F.struct("start", "n", "shift", "seed")
    open_rows = settled.where("NOT whole").groupBy("id", "version").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    joined = placed.join(open_rows.hint("shuffle_hash"), ["id", "version"]).select("id", "version", "packed", "rows")
    left = materialise(open_bytes(joined, width), "suffixes")
    sliced = left.where("sliced")
    common = sliced.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select("seed")
    few = left.where("NOT sliced").unionByName(sliced.join(common, "seed", "left_anti"))
    by_suffix = suffix_runs(small_batches(few.repartition("seed").sortWithinPartitions("seed")), width)
    each = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - width)).alias("k")
    single = sliced.join(common, "seed", "left_semi").select("id", "version", "start", "bytes", each)
    later = later_suffixes(single.select("id", "version", (F.col("start") + F.col("k")).alias("start"), F.substring("bytes", F.col("k") + 1, F.lit(width)).alias("bytes")))
    found = settled.where("whole").select(*position, "n").unionByName(by_suffix)
    return found.unionByName(later.select(*position, F.lit(1).alias("n")))


def spans_of(runs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal byte spans that runs of windows (first, how many) cover."""
    spans: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        end = start + n - 1 + width
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))
    return spans


def packed_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``rows`` and the text as a zstandard frame, which is what moves between tasks."""
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), packed], [*names, "packed"])

    return rows.mapInArrow(tidy(run), f"{schema}, packed binary")


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")


def remove_copies(
    docs: DataFrame,
    keep: list[str],
    width: int = 100,
    seed: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
    results: tuple[str, ...] = RESULTS,
    as_text: bool = False,
    **placement: int,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, n_bytes, n_removed, n_spans and kept: the bytes left, joined. ``results`` gives
    these four other names; ``as_text`` reads what is left as UTF-8, where a character that a cut divides goes whole; ``placement`` goes to ``copied_windows`` and changes no result."""
    names = [f"_c{k}" for k in range(len(keep))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"),
            F.hash(text).alias("version"),
            text.alias("text"),
            *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)),
        )
    )
    placed = packed_rows(rows, ["id", "version", *names]).repartition("id", "version")
    copied = copied_windows(rows.select("id", "version", "text"), placed, width, seed, **placement)
    run_of = F.struct("start", "n")
    copied = copied.groupBy("id", "version").agg(F.collect_list(run_of).alias("runs"))
    joined = placed.join(copied.hint("shuffle_hash"), ["id", "version"], "left").select(*names, "packed", "runs")
    schema = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, number, left = [], [], [], []
            for packed, runs in zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = unpack(packed)
                spans = spans_of([(r["start"], r["n"]) for r in runs or ()], width)
                at, parts = 0, []
                for begin, end in spans:
                    parts.append(data[at:begin])
                    at = end
                rest = b"".join([*parts, data[at:]])
                left.append(rest.decode("utf-8", "ignore") if as_text else rest)
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                number.append(len(spans))
            counts = [pa.array(x, pa.int64()) for x in (sizes, removed, number)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *counts, pa.array(left, pa.string() if as_text else pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"]
            )

    found = joined.mapInArrow(tidy(run), (f"{schema}, " if names else "") + "n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary"))
    renamed = (F.col(n).alias(c) for n, c in zip((*names, *RESULTS), (*keep, *results), strict=True))
    return found.select(*renamed)


def deduplicated(docs: DataFrame, width: int = 100, seed: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later copies cut out of the text. A character that a cut divides goes whole; documents of
    which nothing is left go, documents that were empty or null stay."""
    was_null, *results = unused(docs, "_was_null", *RESULTS)
    others = [c for c in docs.columns if c != text_col]
    marked = docs.withColumn(was_null, F.col(text_col).isNull())
    found = remove_copies(marked, [*others, was_null], width, seed, id_col, text_col, tuple(results), as_text=True)
    found = found.withColumn(text_col, F.when(~F.col(was_null), F.col(results[3])))
    return found.where((F.col(results[1]) == 0) | (F.length(text_col) > 0)).select(docs.columns)
