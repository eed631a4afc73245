"""Quality scores: held-out separation, folds, defined results."""

import math
import zlib

import zstandard
from pyspark.sql import functions as F

from quantloom.llm import quality
from quantloom.llm.sampling import spread_blocks


def test_held_out_separation(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, quality.not_held_out())
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(~quality.not_held_out()).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_fold_is_the_crc_of_the_id(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id")).where(quality.not_held_out())
    assert {r["doc_id"] for r in df.collect()} == {k for k in range(1000) if zlib.crc32(str(k).encode()) % 4 != 2}


def test_defined_results(documents):
    docs = documents([(1, None), (2, ""), (3, "text"), (3, "text"), (4, "long text " * 50_000)])
    untrained = quality.train([])
    assert {r["score"] for r in quality.score(docs, untrained, ["doc_id"]).collect()} == {0.5}
    samples = [(1, f"a calm sentence about the sea and the hills, number {k}, with its end. " * 8) for k in range(60)]
    samples += [(0, f"BUY!!! $$$ {k} *** click *** " * 20) for k in range(60)]
    model = quality.train(samples)
    out = quality.score(docs, model, docs.columns, out_col="found")
    got = {r["doc_id"]: r["found"] for r in out.collect()}
    assert out.columns == [*docs.columns, "found"] and got[1] == got[2] and all(0 <= x <= 1 for x in got.values())
    assert model.score([samples[0][1]])[0] > 0.8 > 0.2 > model.score([samples[-1][1]])[0]
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_scores_by_definition(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    slope, constant = model.weights
    for r in quality.score(docs, model, ["doc_id", "text"]).limit(60).collect():
        data, saved = (r["text"] or "").encode(), 0
        for at in range(0, len(data), 500):
            sizes = []
            for dictionary in (model.bad, model.good):
                c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False)
                sizes.append(len(c.compress(data[at : at + 500])))
            saved += sizes[0] - sizes[1]
        want = 1 / (1 + math.exp(-(slope * saved / max(len(data), 1) + constant)))
        assert abs(r["score"] - want) < 1e-9


def test_learns_only_from_its_fold_and_from_agreed_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, quality.not_held_out())
    turned = labels.withColumn("quality", F.when(quality.not_held_out(), F.col("quality")).otherwise(1 - F.col("quality")))
    assert quality.fit(docs, turned, quality.not_held_out()) == model
    both = labels.unionByName(labels.limit(5).withColumn("quality", 1 - F.col("quality")))
    without = labels.join(labels.limit(5).select("doc_id"), "doc_id", "left_anti")
    assert quality.fit(docs, both) == quality.fit(docs, without)


def test_long_texts_teach_by_spaced_blocks(spark):
    text = "".join(f"{k:06d}" for k in range(20_000))
    df = spark.createDataFrame([(text,), ("short",)], "t string").select(spread_blocks(F.col("t"), 20_000, 4_000).alias("t"))
    found = [r["t"] for r in df.collect()]
    parts = found[0].split("\n")
    assert [len(x) for x in parts] == [4000] * 5 and parts[0] == text[:4000] and parts[-1] == text[-4000:] and found[1:] == ["short"]
