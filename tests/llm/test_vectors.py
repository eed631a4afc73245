"""Operators on vectors against brute force: near copies, clusters, hard negatives."""

import hashlib
import math
import tracemalloc

import numpy as np
import pytest

from quantloom.llm import hard_negatives, kmeans, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def vectors(spark):
    """Rows (vec_id, embedding, label), with extra columns whose names clash with inner ones."""

    def make(rows, clashing=True, schema=SCHEMA):
        df = spark.createDataFrame(rows, schema)
        if clashing:
            for name in ("id", "vec", "row", "node", "block", "kind", "cluster", "class", "dim", "slot", "upper", "n_links", "kept", "rank"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)

    return make


def table(seed=1, n=240, dim=64, labels=3):
    """Random unit vectors, groups of near copies of several tightness, chains, exact copies, awkward rows."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    base = [unit(rng.normal(size=dim)) for _ in range(8)]
    for k in range(n):
        x = unit(rng.normal(size=dim))
        if k % 2:
            noise = (0.002, 0.02, 0.035, 0.05)[k % 8 // 2]
            x = base[k % 8] + rng.normal(size=dim) * noise
        rows.append((k, [float(v) for v in np.float32(x)], int(k % 5 == 0) + (k % labels if k % 3 else 0)))
    turn = unit(rng.normal(size=dim)), unit(rng.normal(size=dim))
    other = unit(turn[1] - turn[1] @ turn[0] * turn[0])
    for k in range(12):  # a chain: each is linked with its neighbours only
        rows.append((1000 + k, [float(v) for v in np.float32(3 * (math.cos(k * 0.3) * turn[0] + math.sin(k * 0.3) * other))], 1))
    rows += [(2000 + k, rows[7][1], rows[7][2]) for k in range(5)]
    return rows


def awkward(dim=64):
    flat = [1.0] * dim
    return [
        (9000, None, 1), (9001, [0.0] * dim, 1), (9002, [None] + flat[1:], 1), (9003, [float("nan")] + flat[1:], 1), (9004, flat, None),
        (9005, [float("inf")] + flat[1:], 1), (9006, [], 1), (9007, flat[:5], 1), (9008, flat[:5], 1), (None, flat, 1), (9009, flat, 1),
        (9010, [2.0] * dim, 1), (9010, [2.0] * dim, 1), (9011, [-0.0] + flat[1:], 2), (9012, [0.0] + flat[1:], 2), (9100, [1e30] * dim, 2),
        (9101, [1e-30] * dim, 2),
    ]


def fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def near(rows, threshold=0.93):
    n = len(rows)
    usable = [fine(v) and any(v) and label is not None for _, v, label in rows]
    x = [np.array(v, float) if u else None for u, (_, v, _) in zip(usable, rows, strict=True)]
    links = {k: [] for k in range(n)}
    for a in range(n):
        for b in range(n):
            if a != b and usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b])) >= threshold:
                    links[a].append(b)
    out = []
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[k][0], len(links[k]), least, rows[k][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("parameters", [{}, {"tile_rows": (7, 16)}, {"tile_rows": (7, 16), "nodes_per_pivot": 12}, {"nodes_per_pivot": 1, "tile_rows": (2, 3)}])
def test_links_and_components_match_all_pairs(vectors, parameters):
    rows = table() + awkward()
    found = vector_dedup.near_vectors(vectors(rows), **parameters)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = near(rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert max(r[1] for r in expected) > 8 and len({r[2] for r in expected}) < len(expected)


def test_other_types_of_labels_and_components(vectors):
    rows = [(k, [math.cos(k * 0.2), math.sin(k * 0.2)], "ab"[k % 2]) for k in range(30)]
    df = vectors(rows, schema="vec_id long, embedding array<double>, label string")
    assert sorted((tuple(r) for r in vector_dedup.near_vectors(df, tile_rows=(3, 5)).collect()), key=str) == near(rows)


def test_rounding_bound_holds_for_every_pair():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 64)), rng.normal(size=(60, 64)) * np.exp(3 * rng.normal(size=(60, 64))), np.eye(64)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, error = vector_dedup.quantised(x)
    q, scale = q.astype(float), scale.astype(float)
    assert np.abs(q).max() <= 127
    estimate = (q * scale[:, None]) @ (q * scale[:, None]).T
    room = error[:, None] + (1 + error[:, None]) * error[None, :]
    assert (np.abs(u @ u.T - estimate) <= room + vector_dedup.PRODUCT_SLACK).all()


def lloyd(rows, n_clusters=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v is not None and len(v) == dim and fine(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [r[1] for r in order[:n_clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((distance(v, c), k) for k, c in enumerate(centroids))[::-1] for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(centroids)):
            of = [v for (_, v), (cluster, _) in zip(kept, at, strict=True) if cluster == k]
            if of:
                centroids[k] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    at = assign()
    inertia = [sum(d for c, d in at if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (c, d) in zip(kept, at, strict=True)], key=str)


def small(rows):
    return [r for r in rows if not (r[1] and fine(r[1]) and max(map(abs, r[1]), default=0) > 1e6)]


@pytest.mark.parametrize("n_clusters", [1, 2, 7, 40])
def test_clusters_match_plain_rounds(vectors, n_clusters):
    rows = small(table(2) + awkward())
    found = kmeans.clusters(vectors(rows), n_clusters=n_clusters)
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows, n_clusters)


def test_fewer_vectors_than_centroids_and_ties(vectors):
    rows = [(k, [float(k % 2)] * 64, 0) for k in range(6)] + [(3, [0.5] * 64, 0)]
    found = kmeans.clusters(vectors(rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows)


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(5)
    middles = rng.integers(-150, 150, (10, 64))
    x = np.concatenate([m + rng.integers(-9, 9, (200, 64)) for m in middles]).astype(np.int64)
    before = middles[:, ::1] + rng.integers(-3, 4, middles.shape)
    after = before + rng.integers(-2, 3, middles.shape)
    cluster, upper, lower = kmeans.assigned(x, before)
    cluster, upper, lower, scans = kmeans.moved(x, cluster, upper, lower, after, kmeans.drifts(before, after))
    assert (cluster == kmeans.squared_distances(x, after).argmin(axis=1)).all()
    assert scans < len(x) / 10


def test_sums_beyond_doubles_stay_exact():
    x = np.array([[2**24 - 1, -(2**24)] * 32, [2**24 - 2, -(2**24)] * 32], np.int64)
    assert kmeans.squared_distances(x, x).tolist() == [[0, 32], [32, 0]]


def mined(rows, n_positives=5, n_negatives=10):
    kept = [(i, np.array([math.floor(256 * c) for c in v], object), label) for i, v, label in rows if fine(v) and label is not None]
    out, last = [], lambda i: (i is None, i)
    for a, (i, x, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y) if len(y) else 0, last(j), j, other) for b, (j, y, other) in enumerate(kept) if b != a and len(y) == len(x)]
        scored.sort(key=lambda r: r[:2])
        for s, _, j, _ in [r for r in scored if r[3] == label][:n_positives]:
            band = [r for r in scored if r[3] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:n_negatives]
            out += [(i, j, n + 1, r[2], -s, -r[0]) for n, r in enumerate(band)]
    return sorted(out, key=str)


@pytest.mark.parametrize("parameters", [{}, {"block_rows": 2}, {"n_positives": 1, "n_negatives": 3}])
def test_hard_negatives_match_full_scores(vectors, monkeypatch, parameters):
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_LEAF", 4)
    rows = [(i if i is None else i * 20, v, label) for i, v, label in small(table(3, dim=16, labels=2))] + [(100, table(3, dim=16)[5][1], 0), (None, table(3, dim=16)[9][1], 2)]
    rows += [r for r in small(awkward(16)) if r[0] is None or r[0] != 9010]
    found = hard_negatives.hard_negatives(vectors(rows), **parameters)
    whole = {k: v for k, v in parameters.items() if k != "block_rows"}
    assert sorted((tuple(r) for r in found.collect()), key=str) == mined(rows, **whole)


def test_labels_that_are_no_numbers(vectors):
    rows = [(k * 10, v, "xyz"[label % 3]) for k, v, label in table(4, n=60, dim=8)]
    df = vectors(rows, schema="vec_id long, embedding array<float>, label string")
    assert sorted((tuple(r) for r in hard_negatives.hard_negatives(df).collect()), key=str) == mined(rows)


def test_intervals_hold_and_prune(monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 4)
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(6, 12)) * 200
    x = np.concatenate([m + rng.normal(size=(60, 12)) * 8 for m in middles]).astype(np.int64)
    labels = np.arange(len(x)) % 2
    a, b = hard_negatives.Balls(x[::7], labels[::7], 4), hard_negatives.Balls(x, labels, 8)
    score = a.x @ b.x.T
    for i in range(len(a.begin)):
        low, high = hard_negatives.interval(a, np.full(len(b.begin), i), b, np.arange(len(b.begin)))
        for j in range(len(b.begin)):
            below = score[a.begin[i] : a.end[i], b.begin[j] : b.end[j]]
            assert low[j] <= below.min() and below.max() <= high[j]
    ids, scored = np.arange(len(x)), []
    search = hard_negatives.Positives(hard_negatives.Anchors(ids[::7], ids[::7], labels[::7], x[::7]), 5)
    plain = search.anchors.pairs
    search.anchors.pairs = lambda *of: (scored.append(p[2].size) or p for p in plain(*of))
    search.search(hard_negatives.Balls(x, labels, 8), ids, ids)
    assert sum(scored) < len(x) * len(x[::7]) / 4  # half of the pairs of one label


def test_what_is_found_is_added_without_copying_the_rest():
    slots = np.arange(50_000)
    best = hard_negatives.Best(len(slots), 10)
    for n in range(10):
        best.add(slots, slots + n, slots, slots)
    tracemalloc.start()
    best.add(np.array([7, 7, 3]), np.array([12, 1, 10**6]), np.array([1, 2, 3]), np.array([0, 0, 0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000  # the rows of all slots are 16 MB
    assert best.limit[[3, 7, 9]].tolist() == [4, 8, 9]


@pytest.mark.parametrize("largest", [200, 20_000, 2**24])
def test_scores_are_exact_whatever_the_size_of_components(largest):
    rng = np.random.default_rng(8)
    x = rng.integers(-largest, largest, (40, 64), endpoint=True)
    x[::2] = largest - rng.integers(0, 2, (20, 64))
    labels, ids = np.arange(len(x)) // 2 % 2, np.arange(len(x))
    search = hard_negatives.Positives(hard_negatives.Anchors(ids, ids, labels, x), 3)
    search.search(hard_negatives.Balls(x, labels, 4), ids, ids)
    slot, score, found, _ = search.best.found()
    for k, anchor in enumerate(search.anchors.ids):
        others = [(-sum(int(u) * int(v) for u, v in zip(x[anchor], x[j], strict=True)), int(j)) for j in ids if j != anchor and labels[j] == labels[anchor]]
        assert [(-int(s), int(j)) for s, j in zip(score[slot == k], found[slot == k], strict=True)] == sorted(others)[:3]


def test_rows_of_one_file_are_searched_by_many_tasks(vectors, monkeypatch):
    tasks, plain = [], hard_negatives.searched
    monkeypatch.setattr(hard_negatives, "searched", lambda rows, start: (tasks.append(len(rows.inputFiles())), plain(rows, start))[1])
    assert hard_negatives.hard_negatives(vectors(table(5)).coalesce(1)).count()
    assert len(tasks) == 2 and min(tasks) > 1


def test_too_large_components_are_an_error(vectors):
    for run in (kmeans.clusters, hard_negatives.hard_negatives):
        with pytest.raises(Exception, match="beyond"):
            run(vectors([(0, [1e6] * 64, 1), (1, [1.0] * 64, 2)])).collect()


def test_empty_tables(vectors):
    for rows in ([], [r for r in awkward() if r[0] in (9000, 9002, 9003, 9005)]):
        df = vectors(table(n=1)[:1]).limit(0) if not rows else vectors(rows)
        assert vector_dedup.near_vectors(df).count() == len(rows)
        assert kmeans.clusters(df).count() == 0
        assert hard_negatives.hard_negatives(df).count() == 0
