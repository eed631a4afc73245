"""PPM code lengths against a plain coder, held-out accuracy, defined results."""

import math
import random
import zlib

from quantloom.llm import langid


def plain_bits(text, samples):
    """Code length by counting contexts in dictionaries, with method C escapes and exclusion."""
    counts = {}
    for sample in samples:
        data = (langid.GAP + sample.lower()).encode()
        joined = counts.setdefault("data", b"") + data
        counts["data"] = joined
    data, tree = counts["data"], {}
    for at in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER + 1):
            node = tree.setdefault(data[at - k : at], {})
            node[data[at]] = node.get(data[at], 0) + 1
    coded, bits = (langid.GAP + text.lower()).encode(), 0.0
    for at in range(langid.ORDER, len(coded)):
        byte, ruled_out, p = coded[at], set(), 1.0
        for k in range(langid.ORDER, -1, -1):
            node = tree.get(coded[at - k : at])
            if not node:
                continue
            total = sum(node.values())
            if byte in node:
                p *= node[byte] / (total + len(node))
                break
            p *= len(node) / (total + len(node))
            ruled_out = set(node)
            # what the next context gives to bytes not ruled out is scaled up to 1
            p /= 1 - sum(shorter(tree, coded[at - j : at], b) for b in ruled_out for j in [k - 1]) if k else 1 - len(ruled_out) / 256
        else:
            p *= 1 / 256
        bits -= math.log2(p)
    return bits


def shorter(tree, context, byte):
    """Probability of a byte by the context and its shorter ones."""
    node = tree.get(context)
    if context == b"" or node is None:
        node = node or {}
        total = sum(node.values())
        if byte in node:
            return node[byte] / (total + len(node))
        return (len(node) / (total + len(node)) if total else 1.0) / 256 / (1 - len(node) / 256 if total else 1.0)
    total = sum(node.values())
    if byte in node:
        return node[byte] / (total + len(node))
    rest = 1 - sum(shorter(tree, context[1:], b) for b in node)
    return len(node) / (total + len(node)) * shorter(tree, context[1:], byte) / rest


def test_code_lengths_match_a_plain_coder():
    samples = ["the cat sat on the mat", "a rat and a hat", "that cat"]
    trees = langid.train([("en", x) for x in samples])
    for text in ("the rat sat", "cat", "that is that"):
        bits, n = trees.code_lengths([text])
        assert n[0] == len(text) and abs(bits[0, 0] - plain_bits(text, samples)) < 1e-3 * bits[0, 0]


def test_code_lengths_of_several_languages():
    rng = random.Random(5)
    made = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    samples = {"a": [made("abcde", 40) for _ in range(3)], "b": [made("cdefgé", 60) for _ in range(2)], "c": [made("xyz", 20)]}
    trees = langid.train([(k, x) for k, texts in samples.items() for x in texts])
    texts = [made("abcdefgéxyz", 12) for _ in range(6)]
    bits, _ = trees.code_lengths(texts)
    for row, text in zip(bits, texts, strict=True):
        for k, language in enumerate(trees.languages):
            # bytes that only other languages have are known to the trees, so the plain coder learns that they exist too
            want = plain_bits(text, samples[language])
            assert abs(row[k] - want) < 2e-3 * want


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, langid.not_held_out())
    rows = langid.identify(docs, model, ["doc_id", "lang"]).where(~langid.not_held_out()).collect()
    told = [r for r in rows if r["lang"] and r["lang_pred"] != "und"]
    assert len(told) > 30 and sum(r["lang"] == r["lang_pred"] for r in told) / len(told) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_no_letter_is_undetermined_and_extra_columns_stay(documents):
    rows = [(1, None), (2, ""), (3, "1234 !?"), (4, "the word"), (4, "the word"), (5, "é" * 100_000)]
    docs = documents(rows)
    out = langid.identify(docs, langid.train([("en", "the word and the other word"), ("fr", "é le mot et la é é é")]), docs.columns)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in out.collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr")]
    assert langid.identify(docs.limit(0), None, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.fit(docs.limit(0)) is None


def test_learns_only_from_its_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in docs.where(langid.not_held_out()).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
