"""The pipeline's stages against brute force on the driver's smallest tables, and on awkward documents."""

import re

import pytest

import corpus_pipeline
from quantloom.llm import quality
from quantloom.llm.common import materialise, tokenizer_path
from tests.llm.test_near_dedup import brute as near_classes
from tests.llm.test_pack import check_places, library_ids
from tests.llm.test_suffix_dedup import brute as passages

SPACE = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(materialise(stage(spark, out[-1], sf_dir), f"test{k}"))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality_stage_keeps_what_scores_enough(stages, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(stages[0], labels, quality.not_held_out())
    rows = texts(stages[0])
    scores = model.score([t or "" for _, t in rows])
    assert sorted(i for i, _ in texts(stages[1])) == sorted(i for (i, _), s in zip(rows, scores, strict=True) if s >= 0.7)


def test_exact_stage_keeps_the_longest(stages):
    best = {}
    for i, t in texts(stages[1]):
        key = SPACE.sub("", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert sorted(i for i, _ in texts(stages[2])) == sorted(i for _, i in best.values())


def test_near_stage_keeps_one_of_each_class(stages):
    classes = near_classes(texts(stages[2]))
    assert sorted(i for i, _ in texts(stages[3])) == sorted({c for _, c in classes})


def test_passage_stage_cuts_later_copies(stages):
    want = {i: kept.decode("utf-8", "ignore") for i, (_, removed, _, kept) in passages(texts(stages[3]), 100).items() if not removed or kept}
    assert dict(texts(stages[4])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_stage_packs_every_document(stages):
    out = stages[5].collect()
    ids = {i: len(library_ids(t)) for i, t in texts(stages[4])}
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == ids
    check_places(out, 2048)


def test_columns_stay_the_same(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])
    assert tokenizer_path("x").endswith("x")


def test_sequences_can_be_built_from_the_last_table(stages):
    ids = {i: library_ids(t).tobytes() for i, t in texts(stages[4])}
    for r in stages[5].collect():
        assert bytes(r["ids"]) == ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]


AWKWARD = [(None, None), (None, "a document without an id, of a few words."), (900, None), (900, None), (901, ""), (902, " \n\t"), (903, "word"), (904, "é" * 3000), (905, "日本語 text " * 4000), (906, "<|endoftext|> as a text")]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, ids without a label and with two, columns named like inner ones."""
    root = tmp_path_factory.mktemp("awkward")
    good = [(k, f"a calm sentence about the sea and the hills, number {k}, which comes to its end with word {k * k}. " * 8) for k in range(80)]
    bad = [(200 + k, f"BUY!!! $$$ {k} *** click {k * k} *** " * 20) for k in range(80)]
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y", 2) for i, t in [*good, *bad, good[3], (300, good[5][1] + "More."), *AWKWARD]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _quality string, node int, sequence_id string, offset int"
    spark.createDataFrame(rows, schema).write.parquet(str(root / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(80)] + [(200 + k, 0, 0) for k in range(80)] + [(900, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def test_every_stage_takes_awkward_documents(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, materialise(stage(spark, kept, awkward), f"awkward{k}")
        if k < 4:
            assert kept.columns == columns, name
            assert 0 < kept.count() <= before.count(), name
    scored = {r["doc_id"] for r in corpus_pipeline.drop_low_quality(spark, docs, awkward).collect()}
    assert set(range(80)) <= scored and not scored & set(range(200, 280))
    pieces = kept.collect()
    check_places(pieces, 2048)
    last = {(r["doc_id"], r["text"]) for r in before.collect()}
    assert sum(r["length"] for r in pieces) == sum(len(library_ids(t)) for _, t in last)


def test_every_stage_takes_an_empty_table(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), awkward).count() == 0, name


def test_without_labels_of_both_kinds_all_stay(spark, awkward, tmp_path):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).count() == docs.count()
