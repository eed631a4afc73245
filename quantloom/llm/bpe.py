"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges are never simulated on running text. The last token of the encoding of a prefix is the one self-encoding
token that ends there and is compatible with the last token of the encoding before it (a pair is compatible if the
merges of its joined bytes give the pair back). A state therefore holds the longest suffix read that can still begin
a token, and the token chains to every position in that suffix; tokens that all chains share can no longer change and
are emitted, after a lookahead of at most the longest token. States and transitions are made when first met and kept;
when there are more than ``max_states`` of them the transducer starts afresh, which changes no result.

Decoding streams: token bytes go through an incremental UTF-8 state machine that holds back an unfinished character.

Defined results: null text is empty and has no ids; ids are little-endian unsigned 32-bit integers in one binary
value; invalid UTF-8 in decoded bytes (only possible for ids that no text has) becomes U+FFFD; an id outside the
vocabulary is an error; repeated rows get equal results, an empty table gives no rows, other columns of any name don't
matter. Rows are independent: no shuffle, memory bounded by a batch, the memo and the states.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Memo, small_batches, tidy

#: Fixed value: the pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.token = {rank: token for token, rank in ranks.items()}
        self.begins = {token[:k] for token in ranks for k in range(1, len(token) + 1)}
        self.sound: dict[bytes, bool] = {}
        self.reads: dict[bytes, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        start = (b"", ((),), None)
        self.ids, self.states, self.moves = {start: 0}, [start], {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging of a short string; only checks tokens and pairs of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_sound(self, token: bytes) -> bool:
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = self.merge(token) == [token]
        return known

    def fits(self, left: int | None, right: int) -> bool:
        if left is None:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.token[left], self.token[right]
            known = self.merge(a + b) == [a, b]
            if len(self.pairs) > 4 * self.max_states:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def read(self, read: bytes) -> tuple[int, tuple[tuple[int, int], ...]]:
        """For a suffix just read: how much of it can still begin a token, and the tokens that end with it, longest first."""
        ends = tuple(
            (n, self.ranks[t]) for n in range(len(read), 0, -1) if (t := read[-n:]) in self.ranks and self.is_sound(t)
        )
        kept = next(n for n in range(len(read), -1, -1) if n == 0 or read[-n:] in self.begins)
        if len(self.reads) > 2 * self.max_states:
            self.reads.clear()
        self.reads[read] = (kept, ends)
        return kept, ends

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, chains, head = self.states[state]
        read = suffix + bytes((byte,))
        kept, ends = self.reads.get(read) or self.read(read)
        for length, rank in ends:
            before = chains[-length]
            left = before[-1] if before else head
            known = self.pairs.get((left, rank))
            if self.fits(left, rank) if known is None else known:
                break
        window = (*chains[len(chains) - kept :], (*before, rank))
        emitted, first = (), window[0]
        if first:  # the chain to the earliest position is in no chain as a whole unless all share it
            shared, shortest = 0, min(map(len, window))
            while shared < shortest and all(x[shared] == first[shared] for x in window):
                shared += 1
            if shared:
                emitted, head = first[:shared], first[shared - 1]
                window = tuple(x[shared:] for x in window)
        new = (read[len(read) - kept :], window, None if all(window) else head)  # only an empty chain looks at the head
        if (to := self.ids.get(new)) is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = (to, emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(self.states) > self.max_states or len(self.moves) > 4 * self.max_states:
            self.restart()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            state, emitted = moves.get(state << 8 | byte) or self.step(state, byte)
            if emitted:
                out += emitted
        return [*out, *self.states[state][1][-1]]


class Encoder:
    """Text to packed ids, with a bounded memo of pieces."""

    def __init__(self, path: str):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.transducer, self.memo = MergeTransducer(load_ranks(path)), Memo(self.piece, size=400_000)

    def piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.find(text)))


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the characters that are complete, ``end`` what is left over."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if needs > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Kept between tasks: its states are dear and bounded."""
    return Encoder(path)


@functools.lru_cache(maxsize=1)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def decode_ids(ids: bytes, table: dict[int, bytes], block: int = 65_536) -> str:
    stream, out = Utf8Stream(), []
    numbers = np.frombuffer(ids, "<u4")
    for at in range(0, len(numbers), block):
        out.append(stream.feed(b"".join(map(table.__getitem__, numbers[at : at + block].tolist()))))
    return "".join(out) + stream.end()


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers; with ``decoded`` also the text that
    the ids decode to, from the same pass."""
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(ranks_path), token_bytes(ranks_path) if decoded else {}
        for batch in batches:
            ids = [encode(x) for x in batch.column("text").to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns, names = [batch.column("id"), n, pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"]
            if decoded:
                columns.append(pa.array([decode_ids(x, table) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, n_tokens long, ids binary" + ", decoded string" * decoded
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text in ``out_col`` in place of the ids; null ids decode to the empty text."""
    names = [c for c in encoded.columns if c not in (ids_col, out_col)]
    rows = small_batches(encoded.select(*names, F.col(ids_col).alias(out_col)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out_col) + f", `{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            texts = pa.array([decode_ids(x or b"", table) for x in batch.column(out_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], [*names, out_col])

    return rows.mapInArrow(tidy(run), schema)
