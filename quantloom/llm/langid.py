"""Language by prediction by partial matching: the language whose byte context tree gives the shortest code.

For each language the counts of bytes after contexts of 0 to ``order`` bytes form a context tree. The probability of a
byte is that of its longest known context; an unseen byte pays the escape (method C: distinct / (count + distinct))
and goes to the shorter context, where bytes already ruled out are excluded, down to the uniform distribution. As the
statistics are frozen, every node's whole distribution is computed once, and a text's exact code length under each
language is a sum of table entries, found for all bytes of a batch at once.

Training is bounded: ``per_language`` documents of a language, of each at most ``most_chars`` characters (of longer ones
evenly spaced blocks), and ``max_nodes`` contexts of full length (the commonest; rarer ones fall to their shorter
context). Texts are scored whole, in lower case. The model has a table of nodes and bytes for each language, so it grows
with the number of languages that ``lang`` names, not with the rows.

Defined results: null text or text without a letter is ``und`` with score 0, as is all if nothing can be learned; ties
go to the first language in alphabetical order; repeated rows get equal results; an empty table gives no rows; other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches, tidy
from quantloom.llm.sampling import id_remainder, per_class, texts_of

ORDER = 3
GAP = "\n" * ORDER


@dataclass(frozen=True)
class ContextTrees:
    languages: list[str]
    symbols: np.ndarray  # byte -> symbol; 0 for bytes that training never saw
    n_symbols: int
    node: np.ndarray  # context of ORDER symbols as a number -> node of its longest known context
    bits: np.ndarray  # (node, symbol) flat -> bits in each language

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and bytes of each text."""
        data = [(GAP + t.lower()).encode() for t in texts]
        codes = self.symbols[np.frombuffer(b"".join(data), np.uint8)].astype(np.int32)
        n = np.array([len(x) for x in data])
        out = np.zeros((len(texts), len(self.languages)))
        a = self.n_symbols
        cells = self.node[(codes[:-3] * a + codes[1:-2]) * a + codes[2:-1]] * a + codes[3:]  # cell k codes byte k + ORDER
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = np.flatnonzero(n > ORDER)
        if len(full):
            bounds = np.stack([starts[full], starts[full] + n[full] - ORDER], 1).ravel()
            if bounds[-1] == len(cells):
                bounds = bounds[:-1]
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(self.bits[k][cells], bounds, dtype=np.float64)[::2]
        return out, n - ORDER


def train(samples: list[tuple[str, str]], max_nodes: int = 30_000) -> ContextTrees | None:
    """Context trees of (language, text) samples."""
    texts: dict[str, bytes] = {}
    for language, text in samples:
        texts[language] = texts.get(language, b"") + (GAP + text.lower()).encode()
    languages = sorted(texts)
    if not languages:
        return None
    seen = np.unique(np.frombuffer(b"".join(texts.values()), np.uint8))
    symbols = np.zeros(256, np.uint8 if len(seen) < 256 else np.uint16)
    symbols[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    coded = [symbols[np.frombuffer(texts[x], np.uint8)].astype(np.int64) for x in languages]

    def counted(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        number = np.zeros(len(codes) - ORDER, np.int64)
        for back in range(order, -1, -1):
            number = number * a + codes[ORDER - back : len(codes) - back]
        return np.unique(number, return_counts=True)

    probability = [np.full((1, a), 1 / 256) for _ in languages]
    contexts, offset, tables = np.zeros(1, np.int64), 0, [[] for _ in languages]
    node_of = np.zeros(a**ORDER, np.int32)
    numbers = np.arange(a**ORDER, dtype=np.int64)
    for order in range(ORDER + 1):
        grams = [counted(codes, order) for codes in coded]
        here = np.unique(np.concatenate([g // a for g, _ in grams]))
        if order == ORDER and len(here) > max_nodes:
            weight = np.zeros(len(here), np.int64)
            for g, c in grams:
                np.add.at(weight, np.searchsorted(here, g // a), c)
            here = np.sort(here[np.argsort(-weight, kind="stable")[:max_nodes]])
        below = np.searchsorted(contexts, here % a ** max(order - 1, 0)) if order else np.zeros(1, np.int64)
        new = []
        for k, (g, c) in enumerate(grams):
            p = probability[k][below].copy()
            at = np.searchsorted(here, g // a)
            known = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == g // a)
            row, symbol, count = at[known], (g % a)[known], c[known].astype(float)
            total, distinct = np.bincount(row, count, len(here)), np.bincount(row, minlength=len(here)).astype(float)
            ruled_out = np.bincount(row, p[row, symbol], len(here))
            if order == 0:  # a byte without a symbol stands for 256 - len(seen) of them
                rest = np.maximum(1 - ruled_out, 1e-6)
            else:
                weights = np.ones(a)
                weights[0] = 256 - len(seen)
                rest = np.maximum(p @ weights - ruled_out, 1e-6)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / rest, 1.0)
            p *= escape[:, None]
            p[row, symbol] = count / (total + distinct)[row]
            new.append(p)
            tables[k].append(p)
        probability, contexts = new, here
        at = np.searchsorted(here, numbers % a**order)
        known = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == numbers % a**order)
        node_of[known] = offset + at[known]
        offset += len(here)
    bits = np.stack([-np.log2(np.maximum(np.concatenate(t), 1e-12)).ravel() for t in tables]).astype(np.float32)
    return ContextTrees(languages, symbols, a, node_of, bits)


def fit(
    docs: DataFrame,
    learnable: Column | None = None,
    per_language: int = 400,
    most_chars: int = 32_768,
    max_nodes: int = 30_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> ContextTrees | None:
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.where(learnable) if learnable is not None else usable
    chosen = per_class(usable.select(id_col, lang_col), lang_col, id_col, per_language)
    return train(texts_of(docs, chosen.distinct(), id_col, text_col, lang_col, most_chars), max_nodes)


def identify(docs: DataFrame, model: ContextTrees | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred, score, and bits_per_byte of the language predicted."""
    names = [f"_c{k}" for k in range(len(keep))]
    rows = small_batches(docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).alias("_t")))
    rows = rows.withColumn("_t", F.when(F.col("_t").rlike(r"\p{L}"), F.col("_t")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t")
    model = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            told = [k for k, t in enumerate(texts) if t is not None] if trees else []
            language, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for at in range(0, len(told), 64):
                part = told[at : at + 64]
                bits, n = trees.code_lengths([texts[k] for k in part])
                best = bits.argmin(1)
                # posterior at equal priors, with the evidence of a text counted by the root of its length
                gap = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                posterior = 1 / np.exp2(-np.minimum(gap, 60)).sum(1)
                for i, k in enumerate(part):
                    language[k], score[k], rate[k] = trees.languages[best[i]], float(posterior[i]), float(bits[i, best[i]] / n[i])
            columns = [*(batch.column(n) for n in names), pa.array(language, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rate, pa.float64())], [*names, "_l", "_s", "_b"])

    found = rows.mapInArrow(tidy(run), f"{schema}, _l string, _s double, _b double")
    renamed = (F.col(n).alias(c) for c, n in zip(keep, names, strict=True))
    return found.select(*renamed, F.col("_l").alias("lang_pred"), F.col("_s").alias("score"), F.col("_b").alias("bits_per_byte"))


def not_held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 3) != 1
