"""Nearest vectors by blocks of products."""

import numpy as np

from quantloom.operators import alike, indicators


def test_nearest_meets_in_blocks_and_ranks_odd_vectors(spark):
    """Copies tie by id, a zero vector's similarity is NaN and ranks first, null ones come last; nothing is broadcast or joined."""
    rows = [(k, [1.0, 2.0, 2.0]) for k in range(5)] + [(5, [2.0, 4.0, 4.0000000001]), (6, [0.0, 0.0, 0.0]), (7, None), (8, [1.0, None, 2.0]), (9, [3.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = indicators.nearest(vectors.where("vec_id IN (0, 7)"), vectors, k=9, blocks=2)
    of = lambda q: [(r["vec_id"], str(r["similarity"])) for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])]
    assert of(0) == [(6, "nan"), (1, "1.0"), (2, "1.0"), (3, "1.0"), (4, "1.0"), (5, "1.0"), (9, "0.333333333"), (7, "None"), (8, "None")]
    assert of(7) == [(k, "None") for k in (0, 1, 2, 3, 4, 5, 6, 8, 9)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Broadcast" not in plan


def test_nearest_of_a_block_keeps_each_candidate(spark):
    """Against all pairs, with products cut into slices."""
    r = np.random.default_rng(3)
    a = r.normal(size=(300, 8)).round(1)
    a[200:] = a[:100] * 2.0
    old, alike.PAIRS = alike.PAIRS, 1000
    try:
        i, j, s = alike.candidates(a[:50], a, np.arange(50), np.arange(300), 4)
    finally:
        alike.PAIRS = old
    full = a @ a.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(a, axis=1))
    for q in range(50):
        want = sorted((-round(full[q, v], 9), v) for v in range(300) if v != q)[:4]
        assert sorted((-round(x, 9), v) for v, x in zip(j[i == q].tolist(), s[i == q].tolist(), strict=True))[:4] == want
