"""The vectors of a block that are most alike to each query of a part: matrix products say which may be, their exact similarities
are computed again in one order of the components, so that they don't depend on how rows were grouped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Vectors in a block, queries in a part, and pairs of a product at a time.
VECTORS, QUERIES, PAIRS = 16_384, 4_096, 2_000_000
#: Similarities are ranked to nine digits: what is further below the k-th can't be among the first k.
MARGIN = 1.5e-9


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that are not null, and the vectors as rows."""
    column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
    return out


def ordered_sum(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, summed from the first component to the last."""
    total = np.zeros(len(i))
    for c in range(a.shape[1]):
        total += a[i, c] * b[j, c]
    return total


def candidates(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, similarity): all pairs that may be among the first ``k`` of a row of a. ``of_a`` and ``of_b`` number
    the ids in their order; rows with one id don't meet. Of equal similarities the first ``k`` ids are enough."""
    every_a, every_b = np.arange(len(a)), np.arange(len(b))
    long_a, long_b = np.sqrt(ordered_sum(a, a, every_a, every_a)), np.sqrt(ordered_sum(b, b, every_b, every_b))
    found = []
    step = max(PAIRS // len(b), 1)
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        near = (a[part] @ b.T) / (long_a[part, None] * long_b)
        near[np.isnan(near)] = np.inf  # ranks first
        own = np.isin(of_a[part], of_b)
        near[own] = np.where(of_a[part][own][:, None] == of_b, -np.inf, near[own])
        last = np.partition(near, len(b) - k, axis=1)[:, len(b) - k] if k < len(b) else np.full(len(near), -np.inf)
        i, j = np.nonzero((near >= last[:, None] - MARGIN) & (near > -np.inf))
        i += start
        exact = ordered_sum(a, b, i, j) / (long_a[i] * long_b[j])
        rank = np.where(np.isnan(exact), np.inf, exact)
        order = np.lexsort((of_b[j], -rank, i))
        i, j, exact, rank = i[order], j[order], exact[order], rank[order]
        fresh = np.append(True, (i[1:] != i[:-1]) | (rank[1:] != rank[:-1]))[: len(i)]
        at = np.arange(len(i))
        keep = at - np.maximum.accumulate(np.where(fresh, at, 0)) < k
        found.append((i[keep], j[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best(k: int, schema: T.StructType, queries: pa.Table, vectors: pa.Table) -> pa.Table:
    """(query_id, vec_id, similarity) of one part of the queries and one block of the vectors, both (id, e)."""
    out = to_arrow_schema(schema)
    if not len(queries) or not len(vectors):
        return out.empty_table()
    q_ids, v_ids = queries["id"].combine_chunks(), vectors["id"].combine_chunks()
    codes = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (q_ids, v_ids)]), return_inverse=True)[1]
    of_q, of_v = codes[: len(q_ids)], codes[len(q_ids) :]
    by_length, found, met = matrices(vectors["e"]), [], np.zeros(len(q_ids), bool)
    in_order = np.argsort(of_v, kind="stable")

    def without(q_at: np.ndarray, v_at: np.ndarray) -> None:
        """Pairs without a similarity: the first ``k`` ids of those vectors that are not in ``v_at``."""
        rest = in_order[~np.isin(in_order, v_at)]
        for i in q_at if len(rest) else ():
            j = rest[of_v[rest] != of_q[i]][:k]
            found.append((np.full(len(j), i), j, np.zeros(len(j)), np.ones(len(j), bool)))

    with np.errstate(all="ignore"):
        for n, (q_at, a) in matrices(queries["e"]).items():
            met[q_at] = True
            v_at, b = by_length.get(n, (np.zeros(0, int), np.zeros((0, n))))
            if len(b):
                i, j, similarity = candidates(a, b, of_q[q_at], of_v[v_at], k)
                found.append((q_at[i], v_at[j], similarity, np.zeros(len(i), bool)))
            without(q_at, v_at)
    without(np.flatnonzero(~met), np.zeros(0, int))
    if not found:
        return out.empty_table()
    i, j, similarity, null = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.Table.from_arrays([q_ids.take(pa.array(i)), v_ids.take(pa.array(j)), pa.array(similarity, mask=null)], schema=out)
