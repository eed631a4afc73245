"""Packing: ids against the tokenizer library, gapless sequences, closeness to the bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import pack, queries
from quantloom.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ENCODE, LIBRARY = pack.WordTokenizer(PATH), Tokenizer.from_file(PATH)


def library_ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_words_of_plain_texts_are_the_library_s(text):
    assert ENCODE(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_plain_character_between_letters():
    for code in [*range(0x20, 0x7F), *range(0xA1, 0x250)]:
        text = f"a{chr(code)}b {chr(code)}{chr(code)} 1{chr(code)}'{chr(code)}s"
        assert ENCODE(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(code)


def check_places(rows, max_len):
    by = defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= max_len
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= max_len
    return len(by)


TEXTS = [None, "", "Hello, WORLD! don't stop", "naïve Ünï 12345 ©®", "日本語 text", "a" * 3000, "x y " * 3000, "<|endoftext|> tab\tnew\nline", "hello <|endoftext|> world", "a <|STARTOFTEXT|> b <| c", "日本語 <|startoftext|>x " * 9000, "ǅ İ ß ﬁ", "same", "same"]


def test_pieces_match_the_library(documents):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    pieces = pack.tokenise(documents(rows), PATH, max_len=2048)
    out = pack.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), max_len=2048).collect()
    want = []
    for k, t in rows:
        ids = library_ids(t)
        want += [(k, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    check_places(out, 2048)


@pytest.mark.parametrize("kind", ["mixed", "one length", "large", "small", "hot"])
def test_few_sequences(spark, kind):
    rng = random.Random(1)
    draw = {
        "mixed": lambda: min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1),
        "one length": lambda: 700,
        "large": lambda: rng.randint(520, 2048),
        "small": lambda: rng.randint(1, 300),
        "hot": lambda: rng.choice([683, 683, rng.randint(1, 2048)]),
    }[kind]
    lengths = [draw() for _ in range(3000)]
    pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    out = pack.pack(pieces).collect()
    used = check_places(out, 2048)
    assert sorted(r["length"] for r in out) == sorted(lengths)
    first_fit = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(first_fit) if room >= n), None)
        if at is None:
            first_fit.append(2048 - n)
        else:
            first_fit[at] -= n
    assert used <= len(first_fit) * 1.01 + 1 and used >= -(-sum(lengths) // 2048)


def test_empty_table(documents):
    pieces = pack.tokenise(documents([(1, "x")]).limit(0), PATH)
    assert pack.pack(pieces.drop("ids")).count() == 0


def test_op8_places_the_ids_themselves(spark, sf_dir, monkeypatch):
    seen = []
    place = pack.pack
    monkeypatch.setattr(pack, "pack", lambda pieces, **k: seen.append(pieces.columns) or place(pieces, **k))
    out = queries.op8_best_fit_packing(spark, sf_dir)
    assert seen == [["doc_id", "piece", "start", "length", "ids"]]
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: library_ids(t).tobytes() for i, t in texts.items()}
    rows = out.collect()
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in rows)
    check_places(rows, 2048)
