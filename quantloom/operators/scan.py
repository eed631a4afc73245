"""Recursive means y = r y + b over series as composed affine maps, in window functions that share one shuffle and sort.

A series is cut into blocks of rows. Within a block the recursion from nothing is a running sum of b r^-k times r^k, which
is stable as later terms outweigh earlier ones, so blocks are short enough for r^-k to be a double. A block as a whole is the
affine map y -> r^size y + last. What comes into a block is these maps composed over the blocks before it, of which
only those matter whose factor still moves a double; every row adds that, damped by its place."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


@dataclass
class Smoothing:
    """A mean seeded by the plain mean of the first ``n`` values, null before; later values weigh ``alpha``. The first
    ``skip`` rows of a series have no value."""

    out: str
    value: Column
    n: int
    alpha: float
    skip: int = 0

    def blocks_back(self) -> int:
        """Blocks whose factor is above 1e-18."""
        return math.ceil(math.log(1e-18) / (BLOCK * math.log(1 - self.alpha)))


def blocked(rows: DataFrame, key: str = "instrument_id", at: str = "ts") -> DataFrame:
    """``rows`` with position (from 1), _block and _k, the place in it."""
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(at)))
    return placed.withColumn("_block", F.floor((F.col("position") - 1) / BLOCK)).withColumn("_k", (F.col("position") - 1) % BLOCK)


def smoothed(rows: DataFrame, means: Sequence[Smoothing], key: str = "instrument_id") -> DataFrame:
    """``rows`` of ``blocked`` with a column for each mean. A first block must hold all seeds."""
    for m in means:
        if m.n + m.skip > BLOCK or (1 - m.alpha) ** -BLOCK > 1e300:
            raise ValueError(f"{m.out}: too long or too short for blocks of {BLOCK} rows")
    # the block is in the order of a series as well, so that all windows are met by one sort
    series, block = Window.partitionBy(key).orderBy("_block", "position"), Window.partitionBy(key, "_block").orderBy("position")
    added = {}
    for m in means:
        at = F.col("position") - m.skip
        seed = F.avg(m.value).over(series.rowsBetween(1 - m.n, 0))
        added[f"_b_{m.out}"] = F.when(at == m.n, seed).when(at > m.n, F.lit(m.alpha) * m.value).otherwise(F.lit(0.0))
    rows = rows.withColumns(added)
    running, power = block.rowsBetween(Window.unboundedPreceding, 0), lambda m, k: F.pow(F.lit(1 - m.alpha), k)
    rows = rows.withColumns({f"_e0_{m.out}": F.sum(F.col(f"_b_{m.out}") * power(m, -F.col("_k"))).over(running) * power(m, F.col("_k")) for m in means})
    before, is_end = series.rowsBetween(Window.unboundedPreceding, -1), F.col("_k") == BLOCK - 1
    for back in range(1, max(m.blocks_back() for m in means) + 1):
        # where the recursion from nothing has come to at the end of the block so many before
        rows = rows.withColumns({f"_e{back}_{m.out}": F.last(F.when(is_end, F.col(f"_e{back - 1}_{m.out}")), True).over(before) for m in means if back <= m.blocks_back()})
    out = {}
    for m in means:
        came_in = F.lit(0.0)
        for back in range(1, m.blocks_back() + 1):
            came_in = came_in + F.coalesce(F.col(f"_e{back}_{m.out}"), F.lit(0.0)) * (1 - m.alpha) ** (BLOCK * (back - 1))
        y = F.col(f"_e0_{m.out}") + power(m, F.col("_k") + 1) * came_in
        out[m.out] = F.when(F.col("position") - m.skip >= m.n, y)
    rows = rows.withColumns(out)
    return rows.drop(*(c for c in rows.columns if c.startswith(("_b_", "_e")) and c.split("_", 2)[-1] in out))


def ema(n: int) -> float:
    return 2 / (n + 1)


def wilder(n: int) -> float:
    return 1 / n
