"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

The plan is made on the histogram of piece lengths, which has at most ``max_len`` rows whatever the corpus holds:

1. lengths above ``max_len // small_share`` are large; the sorted large pieces fall into ``groups`` groups of equal
   cardinality, and each length is rounded up to the largest of its group;
2. few-size configurations are found by a knapsack over the rounded sizes still in stock: the fullest bin that holds
   the largest size, used as often as the stock allows;
3. actual lengths take the places of the rounded ones, longest first, so the rounding is given back;
4. the small pieces go, longest first, into the bin with the least room that still takes them, else into a new bin.

Bins with the same contents are one entry with a count, so the plan's size depends on ``max_len`` and ``groups``
only, and it is safe to send to every task. Pieces find their place by their rank among the pieces of their length;
the ranks come from counts by (length, bucket), so that a length which a third of all rows share is spread over
``buckets`` keys.

Defined results: null text is empty; an empty document is the closing id alone; documents above ``max_len`` ids are
cut into pieces of ``max_len``; rows repeated with their id are packed each; an empty table gives no rows. Names of
special tokens in a text become those tokens, as in the library. ``tokenise`` takes the id and the text only, whatever
else the table has; ``pack`` keeps all columns of the pieces.
"""

from __future__ import annotations

import os
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import Memo, materialise, small_batches, tidy, unused

#: What is not in texts whose normalising is lower case alone; lower-case letters and numbers of such texts; and
#: the vocabulary's word pattern over them (letters, one number, or signs; endings after an apostrophe).
PLAIN = r"[^\t\n\r\x20-\x7e\xa1-ɏ]"
LETTERS, NUMBERS = "a-zªµºß-öø-ʯⱥⱦ", "0-9²³¹¼½¾"
WORDS = rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+"


#: The sign of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {byte: chr(0x100 + k) for k, byte in enumerate(sorted(set(range(0x100)).difference(SHOWN)))}


class WordTokenizer:
    """A public word vocabulary; words met before come from a bounded memo, unusual texts and those that may name a
    special token go through the library, in parts of about ``part`` characters that are cut between words."""

    def __init__(self, path: str, part: int = 20_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.part = self.tokenizer.model, part
        self.find, self.unusual = re.compile(WORDS).findall, re.compile(PLAIN).search
        self.memo = Memo(self.word, size=250_000)

    def word(self, word: str) -> bytes:
        ids = [token.id for token in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_SIGNS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        found, at = [], 0
        while at < len(text):
            end = at + self.part
            end = len(text) if end >= len(text) else text.find(" ", end)
            end = len(text) if end < 0 else end
            found.append(np.array(self.tokenizer.encode(text[at:end], add_special_tokens=False).ids, "<u4").tobytes())
            at = end
        return b"".join(found)

    def __call__(self, text: str) -> bytes:
        if self.unusual(text) or "<|" in text:
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, self.find(text.lower())))


def tokenise(
    docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, piece, start, length, ids): the ids of each piece as little-endian unsigned 32-bit integers."""
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    id_type = rows.schema["id"].dataType.simpleString()
    closing, step = np.array([end_id], "<u4").tobytes(), 4 * max_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(tokenizer_path)
        for batch in batches:
            at, piece, parts = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + closing
                for n, begin in enumerate(range(0, len(ids), step)):
                    at.append(k)
                    piece.append(n)
                    parts.append(ids[begin : begin + step])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array([max_len * n for n in piece], pa.int64()),
                    pa.array([len(x) // 4 for x in parts], pa.int64()),
                    pa.array(parts, pa.binary()),
                ],
                ["id", "piece", "start", "length", "ids"],
            )

    schema = f"id {id_type}, piece int, start long, length long, ids binary"
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


class Bins:
    """Bins by the room they have left; bins with equal contents share an entry. Contents are linked lists."""

    def __init__(self, max_len: int):
        self.max_len, self.by_room = max_len, [[] for _ in range(max_len + 1)]

    def add(self, contents: tuple | None, room: int, n: int) -> None:
        if n:
            self.by_room[room].append((contents, n))

    def place(self, length: int, n: int) -> None:
        """Best fit of ``n`` pieces of one length."""
        for room in range(length, self.max_len + 1):
            open_bins, each = self.by_room[room], room // length
            while open_bins and n:
                contents, bins = open_bins.pop()
                full = min(bins, n // each)
                self.add((contents, length, each), room - each * length, full)
                n -= full * each
                if full < bins and n:  # the last of them, for fewer than fill a bin
                    self.add((contents, length, n), room - n * length, 1)
                    full, n = full + 1, 0
                self.add(contents, room, bins - full) if full < bins else None
            if not n:
                return
        each = self.max_len // length
        self.add((None, length, each), self.max_len - each * length, n // each)
        self.add((None, length, n % each), self.max_len - (n % each) * length, int(n % each > 0))


def configurations(sizes: list[int], stock: list[int], max_len: int) -> Iterator[tuple[list[int], int]]:
    """(positions in ``sizes``, how many bins): each the fullest bin with the largest size left."""
    left = list(stock)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for first in order:
        while left[first]:
            # bounded knapsack: by room used, the last size taken and how many of it
            reach = np.full(max_len + 1, -1, np.int32)
            base = sizes[first]
            reach[base] = first
            taken: list[tuple[int, np.ndarray]] = []
            possible = np.zeros(max_len + 1, bool)
            possible[base] = True
            for i in order:
                spare = left[i] - (i == first)
                if spare <= 0 or sizes[i] > max_len - base:
                    continue
                count = np.zeros(max_len + 1, np.int16)
                for k in range(1, min(spare, (max_len - base) // sizes[i]) + 1):
                    shifted = np.zeros_like(possible)
                    shifted[k * sizes[i] :] = possible[: max_len + 1 - k * sizes[i]]
                    new = shifted & ~possible & (count == 0)
                    count[new] = k
                taken.append((i, count))
                possible = possible | (count > 0)
                if possible[max_len]:
                    break
            used = int(np.flatnonzero(possible)[-1])
            chosen = [first]
            for i, count in reversed(taken):
                if count[used]:
                    chosen += [i] * int(count[used])
                    used -= int(count[used]) * sizes[i]
            need = {i: chosen.count(i) for i in chosen}
            n = min(left[i] // k for i, k in need.items())
            for i, k in need.items():
                left[i] -= k * n
            yield chosen, n


def plan(histogram: dict[int, int], max_len: int, groups: int = 1024, small_share: int = 4) -> list[tuple[list[tuple[int, int]], int]]:
    """The bins as (contents as (length, how many), number of such bins), from piece lengths and their counts."""
    bins = Bins(max_len)
    large = sorted((x for x in histogram.items() if x[0] * small_share > max_len), reverse=True)
    total, stock, sizes, queues, seen = sum(n for _, n in large), [], [], [], 0
    for length, n in large:  # groups of equal cardinality; a length is never split between two
        if not sizes or (seen * groups) // total >= len(sizes):
            sizes.append(length)
            stock.append(0)
            queues.append(deque())
        stock[-1] += n
        queues[-1].append((length, n))
        seen += n

    def take(group: int, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, there = queues[group].popleft()
            if there > n:
                queues[group].appendleft((length, there - n))
            out.append((length, min(there, n)))
            n -= out[-1][1]
        return out

    for chosen, n in configurations(sizes, stock, max_len):
        slots = [deque(take(group, n)) for group in chosen]
        while n:
            run = min(slot[0][1] for slot in slots)
            contents, room = None, max_len
            for slot in slots:
                length, there = slot.popleft()
                if there > run:
                    slot.appendleft((length, there - run))
                contents, room = (contents, length, 1), room - length
            bins.add(contents, room, run)
            n -= run
    for length, n in sorted((x for x in histogram.items() if x[0] * small_share <= max_len), reverse=True):
        bins.place(length, n)
    out = []
    for entries in bins.by_room:
        for contents, n in entries:
            held = []
            while contents:
                contents, length, many = contents
                held.append((length, many))
            out.append((held[::-1], n))
    return out


def segments(bins: list[tuple[list[tuple[int, int]], int]], max_len: int) -> dict[str, np.ndarray]:
    """For ranks of each length, in order: where a run of ranks begins, its first bin, pieces in a bin, offset."""
    rows, ranks, base = [], {}, 0
    for contents, n in bins:
        offset = 0
        for length, many in contents:
            start = ranks.get(length, 0)
            rows.append((length, start, base, many, offset))
            ranks[length] = start + n * many
            offset += length * many
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "start": table[:, 1], "base": table[:, 2], "many": table[:, 3], "offset": table[:, 4]}


def pack(pieces: DataFrame, max_len: int = 2048, groups: int = 1024, buckets: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (id_col, piece, length, and what else they have) with sequence_id and offset, which replace columns of
    these names. Pieces of one length are ranked by bucket, id and piece; between rows that repeat all three, any order."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    bucket, rank, before, n = unused(pieces, "_bucket", "_rank", "_before", "_n")
    pieces = materialise(pieces.withColumn(bucket, F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int")), "pieces")
    counts = materialise(pieces.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n)), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(n).alias("n")).collect()}
    where = spark.sparkContext.broadcast(segments(plan(histogram, max_len, groups), max_len))
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", bucket, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("length", bucket).orderBy(id_col, "piece")
    ranked = pieces.join(starts, ["length", bucket]).withColumn(rank, F.col(before) + F.row_number().over(within) - 1)
    ranked = ranked.select(*names, rank)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            length, place = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", rank))
            at = np.searchsorted(table["key"], (length << 48) + place, "right") - 1
            within_run, many = place - table["start"][at], table["many"][at]
            sequence = table["base"][at] + within_run // many
            offset = table["offset"][at] + within_run % many * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(tidy(run), f"{schema}, sequence_id long, offset long")
