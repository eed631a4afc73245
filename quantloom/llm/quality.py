"""Quality by compression: zstandard dictionaries of good and of bad text, and the calibrated difference in size.

A text is cut into blocks of ``block`` bytes, so that a long text can't become its own dictionary. Each block is
compressed once with either dictionary; the difference of the summed sizes over the bytes of the text is the one thing
that decides, and a logistic curve turns it into a probability. The curve is fitted crosswise: each half of the sample is
measured by dictionaries of the other. Every text is scored whole; training is bounded by ``per_label`` documents of a
label, of each at most ``most_chars`` characters: of longer ones evenly spaced blocks.

Defined results: null text is empty; an empty text has difference 0 and gets the score of that; without labels of both
kinds every score is 0.5; ids labelled both good and bad teach nothing; repeated rows get equal scores; an empty table
gives no rows; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches, tidy
from quantloom.llm.sampling import id_remainder, per_class, texts_of


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    block: int = 500
    level: int = 3

    def compressors(self):
        return _compressors(self.good, self.bad, self.level)

    def difference(self, text: str, tools=None) -> float:
        """Bytes that the dictionary of good text saves against that of bad text, for each byte of the text."""
        good, bad = tools or self.compressors()
        data, saved = text.encode(), 0
        for at in range(0, len(data), self.block):
            part = data[at : at + self.block]
            saved += len(bad.compress(part)) - len(good.compress(part))
        return saved / max(len(data), 1)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), 0.5)
        tools, (slope, constant) = self.compressors(), self.weights
        x = np.array([self.difference(t, tools) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x * slope + constant, -40, 40)))


@functools.lru_cache(maxsize=1)
def _compressors(good: bytes, bad: bytes, level: int):
    import zstandard

    plain = {"level": level, "write_content_size": False, "write_checksum": False}
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x), **plain) for x in (good, bad))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, ...]:
    """Newton's method on standardised columns; weights for raw columns, the constant last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
    return (*(w[:-1] / scale), float(w[-1] - (w[:-1] / scale) @ mean))


def dictionaries(samples: list[tuple[int, str]], dictionary_bytes: int, block: int) -> tuple[bytes, bytes] | None:
    import zstandard

    out = []
    for label in (1, 0):
        data = [text.encode() for y, text in samples if y == label]
        parts = [x[i : i + block] for x in data for i in range(0, len(x), block)]
        try:
            out.append(zstandard.train_dictionary(min(dictionary_bytes, sum(map(len, parts)) // 4), parts).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too little text of this label
            return None
    return out[0], out[1]


def train(samples: list[tuple[int, str]], dictionary_bytes: int = 32 * 1024, block: int = 500) -> QualityModel:
    drawn = list(samples)
    random.Random(0).shuffle(drawn)
    halves = drawn[::2], drawn[1::2]
    x, y = [], []
    for learned, judged in (halves, halves[::-1]):  # the curve sees each text by dictionaries that never saw it
        if not (pair := dictionaries(learned, dictionary_bytes, block)):
            return QualityModel(b"", b"", ())
        model = QualityModel(*pair, (), block)
        tools = model.compressors()
        x += [(model.difference(text, tools),) for _, text in judged]
        y += [float(label) for label, _ in judged]
    pair = dictionaries(drawn, dictionary_bytes, block)
    return QualityModel(*pair, tuple(map(float, logistic(np.array(x), np.array(y)))), block)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column | None = None,
    per_label: int = 3000,
    most_chars: int = 65_536,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Learn from at most ``per_label`` documents of either label; ``learnable`` says which labels may be used."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable.where(learnable) if learnable is not None else usable
    agreed = usable.groupBy(id_col).agg(F.min(label_col).alias(label_col), F.max(label_col).alias("_most"))
    agreed = agreed.where(F.col(label_col) == F.col("_most")).select(id_col, label_col)
    chosen = per_class(agreed, label_col, id_col, per_label)
    return train(texts_of(docs, chosen, id_col, text_col, label_col, most_chars))


def score(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of the text, between 0 and 1."""
    names = [f"_c{k}" for k in range(len(keep))]
    rows = small_batches(
        docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t")
    model = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.value.score(batch.column("_t").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], [*names, "_s"])

    scored = rows.mapInArrow(tidy(run), f"{schema}, _s double")
    return scored.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("_s").alias(out_col))


def not_held_out(id_col: str = "doc_id") -> Column:
    return id_remainder(id_col, 4) != 2
