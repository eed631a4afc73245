"""Near-duplicate classes against all pairs of a small corpus."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from quantloom.llm import near_dedup
from quantloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def multiset(text):
    words = WORD.findall(text or "")
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def brute(rows, threshold=0.8):
    """{index of row: smallest doc_id of its class}."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        low, high = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
        if low and low / high >= threshold:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((rows[i][0], least[root(i)]) for i in range(len(rows)))


def found(docs):
    return Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(docs).collect())


def corpus(words, seed):
    rng, rows = random.Random(seed), []
    for k in range(14):
        base = words(rng.randint(60, 200), seed * 100 + k)
        rows.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_classes_match_all_pairs(documents, words):
    rows = corpus(words, 1) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "one two three")]
    assert found(documents(rows)) == brute(rows)


def test_chains_of_copies_join_one_class(documents, words):
    base = words(200, 9)
    rows = []
    for k in range(12):  # each differs from the next by little, the ends by much
        rows.append((k, " ".join(base)))
        base = [*base[3:], f"x{k}", f"y{k}", f"z{k}"]
    assert found(documents(rows)) == brute(rows) and len({c for _, c in brute(rows)}) == 1


def test_repeated_rows_and_survivors(documents, words):
    text = " ".join(words(80, 4))
    docs = documents([(1, text), (1, text), (2, text + " end"), (3, None), (None, text)])
    left = near_dedup.near_dedup(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "None"]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = np.full(400, 2), np.concatenate([np.full(300, 2), np.full(100, 1)])
    agree, want = [], (600 + 100) / 800
    for k in range(20):
        moved = elements ^ np.uint64(k * 7919)
        x, y = (near_dedup.dart_signature(moved, w, 120, 960) for w in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - want) < 0.03


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, k) for k in range(1001, 1060)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 1000 for k in range(1000, 1060)}}


def test_every_row_has_its_similarity_to_the_one_that_stays(documents, words):
    rows = corpus(words, 3) + [(900, None), (901, ""), (903, "one two"), (904, "one two")]
    texts = dict(rows)
    found = near_dedup.near_classes(documents(rows), with_similarity=True).collect()
    assert len(found) == len(rows) and len({r["similarity"] for r in found}) > 5
    for r in found:
        a, b = multiset(texts[r["doc_id"]]), multiset(texts[r["class_id"]])
        expected = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
        assert abs(r["similarity"] - expected) < 1e-12
    assert all(r["similarity"] == 1.0 for r in found if r["kept"])
    assert near_dedup.near_classes(documents(rows).limit(0), with_similarity=True).count() == 0
