"""Square neighbourhoods of any radius over tiles as arrays.

Pixels are dealt to tiles at least as wide as a neighbourhood, those near a border to the neighbouring tiles too, so that one
shuffle moves each pixel at most four times, whatever the radius. In a tile, means come from running sums in both
directions, extremes from running extremes of blocks forwards and backwards, and medians from a count of each value's
running sums, or, where a neighbourhood has fewer places than the tile has values, from the neighbourhoods themselves. So the
work of a tile hardly depends on the radius. Pixels that are not in the table, beyond an edge or missing, take no part and
get no row; null and NaN values count as missing, but keep their row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 64


def _sums(a: np.ndarray, w: int) -> np.ndarray:
    """Sums of all w x w windows."""
    for axis in (0, 1):
        run = np.cumsum(np.insert(a, 0, 0, axis), axis)
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, run.shape[axis] - w), slice(w, None)
        a = run[tuple(hi)] - run[tuple(lo)]
    return a


def _highest(a: np.ndarray, w: int) -> np.ndarray:
    """Largest value of all w x w windows: of a block from its start to here, and from there to the end of the block before."""
    for _ in range(2):
        n = a.shape[0] - w + 1
        blocks = np.concatenate([a, np.full((-a.shape[0] % w, a.shape[1]), -np.inf)]).reshape(-1, w, a.shape[1])
        ahead = np.maximum.accumulate(blocks, 1).reshape(-1, a.shape[1])
        back = np.maximum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1, a.shape[1])
        a = np.maximum(back[:n], ahead[w - 1 : w - 1 + n]).T
    return a


def _median(a: np.ndarray, w: int) -> np.ndarray:
    """Medians of the values of all w x w windows, which are NaN where there are none."""
    known = ~np.isnan(a)
    count = _sums(known.astype(np.int64), w)
    values = np.unique(a[known])
    if len(values) > w * w:
        shape = np.lib.stride_tricks.sliding_window_view(a, (w, w))
        with np.errstate(all="ignore"):
            return np.array([[np.nan if np.isnan(x).all() else np.nanmedian(x) for x in row] for row in shape])
    low, high = np.full(count.shape, np.nan), np.full(count.shape, np.nan)
    below = np.zeros(count.shape, np.int64)
    for v in values:
        upto = below + _sums((a == v).astype(np.int64), w)
        for out, rank in ((low, (count - 1) // 2), (high, count // 2)):
            out[(below <= rank) & (rank < upto) & (count > 0)] = v
        below = upto
    return (low + high) / 2


def _figure(a: np.ndarray, w: int, kind: str) -> np.ndarray:
    known = ~np.isnan(a)
    if kind == "mean":
        with np.errstate(all="ignore"):
            return _sums(np.where(known, a, 0.0), w) / _sums(known.astype(float), w)
    if kind == "median":
        return _median(a, w)
    found = _highest(np.where(known, a if kind == "max" else -a, -np.inf), w)
    found = found if kind == "max" else -found
    if kind == "whole_min":  # a missing neighbour is 0
        return np.where(_sums(known.astype(np.int64), w) == w * w, found, 0.0)
    return np.where(np.isinf(found), np.nan, found)


def square(px: DataFrame, keys: list[str], value: str, radius: int, kind: str, name: str | None = None, tile: int = TILE) -> DataFrame:
    """(keys, r, c, name): mean, median, max, min, or whole_min (0 where a neighbour is missing) of the values at most
    ``radius`` rows and columns away."""
    size, name = max(tile, 2 * radius), name or value
    reach = lambda v: F.explode(F.sequence(F.floor((F.col(v) - radius) / size), F.floor((F.col(v) + radius) / size)))
    own = px.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("_v"))
    dealt = own.withColumn("_tr", reach("r")).withColumn("_tc", reach("c"))
    schema = T.StructType([f for f in own.schema.fields if f.name != "_v"]).add(name, T.DoubleType())

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = (int(p[k].iloc[0]) * size - radius for k in ("_tr", "_tc"))
        r, c = p["r"].to_numpy() - r0, p["c"].to_numpy() - c0
        grid = np.full((size + 2 * radius,) * 2, np.nan)
        grid[r, c] = p["_v"]
        inner = (r >= radius) & (r < size + radius) & (c >= radius) & (c < size + radius)
        found = _figure(grid, 2 * radius + 1, kind)
        return p.loc[inner, [*keys, "r", "c"]].assign(**{name: found[r[inner] - radius, c[inner] - radius]})

    made = dealt.groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema)
    return made.withColumn(name, F.when(~F.isnan(name), F.col(name)))
