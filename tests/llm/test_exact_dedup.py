"""Exact dedup against a dictionary of normalised texts."""

import hashlib
import re

from quantloom.llm import exact_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc_id))
    return {
        (doc_id, min(groups[key])[1], len(groups[key]), hashlib.sha256(key.encode()).hexdigest())
        for doc_id, text in rows
        for key in [SPACE.sub("", text or "")]
    }


ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a b"), (7, "a  b"), (8, "é" * 5000), (9, "é" * 5000 + " "), (10, "a b")] + [
    (k, "same text everywhere") for k in range(100, 200)
]


def found(df):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["sha"].hex()) for r in df.collect()}


def test_groups_match_brute_force_for_any_tree(documents):
    docs = documents(ROWS)
    for runs, fan_in in ((1, 2), (7, 2), (256, 16)):
        df = exact_dedup.exact_groups(docs, runs=runs, fan_in=fan_in)
        assert found(df) == brute(ROWS)
        assert df.where("kept").count() == len({x[3] for x in brute(ROWS)})


def test_survivors_keep_all_columns(documents):
    docs = documents(ROWS)
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({x[1] for x in brute(ROWS)})


def test_repeated_rows_keep_one(documents):
    left = exact_dedup.exact_dedup(documents([(1, "x y"), (1, "x y"), (1, "x  y"), (2, "z"), (None, "w"), (None, "w")]))
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "x  y"), ("2", "z"), ("None", "w")]


def test_empty_table(documents, spark):
    docs = documents(ROWS).limit(0)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == 0
