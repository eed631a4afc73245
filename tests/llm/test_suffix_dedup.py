"""Removal of later passage copies against a dictionary of all windows."""

import random

import numpy as np
import pytest

from quantloom.llm import suffix_dedup


def brute(rows, width):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} by listing every window in order of position."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - width + 1):
            window = data[at : at + width]
            if window in seen:
                gone[at : at + width] = b"\x01" * width
            seen.add(window)
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc_id] = (len(data), sum(gone), spans, kept)
    return out


def found(docs, width, seed, **placement):
    df = suffix_dedup.remove_copies(docs, ["doc_id"], width=width, seed=seed, **placement)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


def prose(words, n_docs, passages):
    rng, rows = random.Random(3), []
    for k in range(n_docs):
        parts = [" ".join(words(rng.randint(0, 60), k))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.append(p)
            parts.append(" ".join(words(rng.randint(0, 9), 1000 + k)))
        rows.append((k, " ".join(parts)))
    return rows


@pytest.mark.parametrize(("width", "seed"), [(12, 4), (40, 12), (100, 32)])
def test_matches_brute_force(documents, words, width, seed):
    passages = [" ".join(words(40, 5000 + k)) for k in range(6)]
    rows = prose(words, 60, passages) + [(900, None), (901, ""), (902, "ab" * 300), (903, "ab" * 300), (904, "é" * 400), (905, "x" * 1000), (906, "short")]
    assert found(documents(rows), width, seed) == brute(rows, width)


def test_overlaps_within_one_document(documents):
    rows = [(1, "abcdefghij" * 40), (2, "q" * 99), (3, "q" * 100), (4, "q" * 101)]
    assert found(documents(rows), 100, 32) == brute(rows, 100)


def test_driver_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, 100, 32) == brute(rows, 100)


def test_long_text_over_several_chunks(documents, monkeypatch, words):
    text = " ".join(words(3000, 1))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 10)
    rows = [(1, text), (2, text[5000:9000] + "!" + text[100:300])]
    hashes, context, start, n, shift = suffix_dedup.anchors(text.encode(), 100, 32)
    assert n.sum() == len(text.encode()) - 99 and (start[1:] == (start + n)[:-1]).all()
    assert found(documents(rows), 100, 32) == brute(rows, 100)


def test_repeated_rows_count_once_and_get_equal_results(documents):
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
    out = suffix_dedup.remove_copies(documents([(1, text), (1, text), (2, text)]), ["doc_id"]).collect()
    removed = sorted((r["doc_id"], r["n_removed"]) for r in out)
    assert removed[0] == removed[1] and removed[0][1] < 400 and removed[2] == (2, 400)


def test_deduplicated_keeps_columns_and_null_texts(documents):
    rows = [(1, None), (2, ""), (3, "é" * 100), (4, "é" * 100 + " end of it")]
    docs = documents(rows)
    left = suffix_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in left.collect()}[1] is None
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("placement", [{"most_rows": 1}, {"most_rows": 3}, {"most_rows": 40}, {"one_in": 1, "hot_share": 10}, {"one_in": 1, "hot_share": 10, "most_rows": 60}])
def test_placement_of_hot_seeds_changes_nothing(documents, words, placement):
    phrase = " ".join(words(30, 77))
    rows = [(k, f"{' '.join(words(k % 7, k))} {phrase[k % 5 :]} {' '.join(words(k % 4, 500 + k))}") for k in range(120)]
    assert found(documents(rows), 60, 20, **placement) == brute(rows, 60)


def test_equal_suffixes_over_several_tasks(spark):
    rng = random.Random(2)
    rows = [(k % 40, 1, k, bytes(rng.choice([b"aaa", b"aaa", b"aaa", b"aab", b"b" + bytes([k % 7])]))) for k in range(600)]
    rows += rows[:50]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "id long, version int, start int, bytes binary")
        assert df.repartitionByRange(*suffix_dedup.ORDER).rdd.getNumPartitions() == 4
        got = {tuple(r) for r in suffix_dedup.later_suffixes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for *position, data in rows:
        least[data] = min(least.get(data, tuple(position)), tuple(position))
    assert got == {tuple(p) for *p, data in rows if tuple(p) > least[data]}


def test_slices_cover_windows_and_agree(words):
    text = " ".join(words(200, 3)).encode()
    hashes, _, start, n, shift = suffix_dedup.anchors(text, 60, 20)
    moved = b"xyz" + text[37:]
    windows, keys = [], {}
    for data in (text, moved):
        for _, _, first, many, to in zip(*suffix_dedup.anchors(data, 60, 20), strict=True):
            for key, at, part in suffix_dedup.slices(data, int(first), int(many), int(to), 60):
                assert data[at : at + len(part)] == part and 60 <= len(part) < 60 + suffix_dedup.SLICE
                for k in range(len(part) - 59):
                    keys.setdefault(part[k : k + 60], set()).add(key)
                    windows.append((data is text, at + k))
    assert sorted(w for own, w in windows if own) == list(range(len(text) - 59))
    assert all(len(x) == 1 for x in keys.values())  # equal windows have equal keys


def test_hot_seeds_are_found(documents, words):
    phrase = " ".join(words(30, 77))
    rows = [(k, f"{' '.join(words(9, k))} {phrase} {' '.join(words(9, 500 + k))}") for k in range(80)]
    texts = documents(rows, clashing=False).selectExpr("doc_id AS id", "1 AS version", "text")
    assert len(suffix_dedup.hot_seeds(texts, 60, 20, 1, 10)) and not len(suffix_dedup.hot_seeds(texts.limit(20), 60, 20, 1, 10))


@pytest.mark.parametrize("seed", range(30))
def test_previous_factors_by_definition(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(8, 90)))
    width = rng.randint(2, 7)
    at = sorted(rng.choices(range(len(text) - width + 1), k=rng.randint(1, 60)))
    windows = np.stack([np.frombuffer(text[k : k + width], np.uint8) for k in at])
    shares = lambda i, j: next((x for x in range(width) if text[i + x] != text[j + x]), width)
    want = [max((shares(i, j) for j in at if j < i), default=0) for i in at]
    assert suffix_dedup.previous_factors(windows, np.array(at)).tolist() == want
