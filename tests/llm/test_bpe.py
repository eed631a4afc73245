"""Transducer encoding against the tiktoken library, decoding against the texts."""

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from quantloom.llm import bpe
from quantloom.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
ENCODE = bpe.encoder(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    packed = ENCODE(text)
    assert ids(packed) == LIBRARY.encode_ordinary(text)
    assert bpe.decode_ids(packed, bpe.token_bytes(PATH), block=3) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehilnorst", min_size=20, max_size=300), st.integers(20, 2000))
def test_long_words_and_few_states(word, states):
    transducer = bpe.MergeTransducer(bpe.load_ranks.__wrapped__(PATH) if hasattr(bpe.load_ranks, "__wrapped__") else RANKS, max_states=states)
    for piece in (word, word * 3, word[::-1]):
        assert transducer.encode(piece.encode()) == LIBRARY.encode_ordinary(piece)


RANKS = bpe.load_ranks(PATH)


def test_documents(documents, spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "émoji 😀😀 ok"), (3, "émoji 😀😀 ok"), (4, "a" * 20_000), (5, " \n\t  x  "), (6, "日本語" * 500)]
    encoded = bpe.encode_documents(documents(rows), PATH)
    got = {r["doc_id"]: (r["n_tokens"], ids(r["ids"])) for r in encoded.collect()}
    want = {k: LIBRARY.encode_ordinary(t or "") for k, t in rows}
    assert got == {k: (len(v), v) for k, v in want.items()}
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(encoded, PATH).collect()}
    assert decoded == {k: t or "" for k, t in rows}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = bpe.encode_documents(docs, PATH).join(docs, "doc_id").collect()
    assert all(ids(r["ids"]) == LIBRARY.encode_ordinary(r["text"] or "") for r in out)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_stream_holds_back_unfinished_characters():
    data = "aé日😀z".encode()
    for cut in range(len(data) + 1):
        stream = bpe.Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.end() == "aé日😀z"
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xe6\x97") == "a" and broken.end() == "�"
