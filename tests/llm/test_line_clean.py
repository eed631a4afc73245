"""Line cleaning: counts against plain Python, verdicts of the line rules."""

import random
import re

from quantloom.llm import line_clean

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_match_brute_force(documents, words):
    rng, rows = random.Random(5), [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "a b c d e " * 6), (5, "x\x0by\x0cz w v " * 3)]
    for k in range(40):
        lines = [" ".join(words(rng.randint(1, 12), k * 50 + j)) for j in range(rng.randint(1, 8))]
        lines += rng.choices(lines, k=rng.randint(0, 3))
        rows.append((10 + k, "\n".join(lines) + rng.choice(["", "###", " 50% & more"])))
    out = line_clean.clean_lines(documents(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in out} == {i: counts(t) for i, t in rows}
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_line_rules(documents):
    good = "The river rose over night and the village was under water by the morning of the third day."
    bad = ["Home | About | News | Contact | Imprint", "Please accept cookies to go on", "$$$ ### *** &&& %%%", "BUY NOW AND SAVE A LOT OF MONEY", "Menu"]
    rows = [(1, "\n".join([good, *bad])), (2, "\n".join([*bad, *bad, *bad, "and ten more words that say nothing at all of it"])), (3, good)]
    out = {r["doc_id"]: r for r in line_clean.clean_lines(documents(rows)).collect()}
    assert out[1]["cleaned_text"] == good and out[1]["n_lines_removed"] == len(bad)
    assert not out[2]["kept"] and out[3]["kept"]
    assert line_clean.clean_lines(documents(rows).limit(0)).count() == 0
