"""Connected regions of pixel masks.

A tile's pixels are labelled together in numpy, several tiles in one call; regions that touch across tile borders are then merged over border labels
only, whose number grows with tile edges, not with pixels: first by union-find among the links of a block of tiles, then by
star contraction of what is left, which takes one round where no region leaves its block. Labels are the smallest
r * width + c of the region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta.checkpoints import cut
from terradelta.operators.graph import stars
from terradelta.operators.tiles import map_tiles

NEIGHBOURS = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def _labels(r: np.ndarray, c: np.ndarray, group: np.ndarray, tile: int, width: int, conn: int) -> np.ndarray:
    """Smallest r * width + c that each pixel reaches within its tile; group: the tiles' numbers."""
    at = (group * (tile + 1) + r % tile) * (tile + 1) + c % tile  # a free row and column apart
    order = np.argsort(at, kind="stable")
    at = at[order]
    a, b = [], []
    for dr, dc in NEIGHBOURS[conn]:
        to = at + dr * (tile + 1) + dc
        k = np.minimum(np.searchsorted(at, to), len(at) - 1)
        hit = np.flatnonzero(at[k] == to)
        a.append(hit)
        b.append(k[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    low = np.arange(len(at))
    while True:
        # the least of two pixels' roots becomes the other root's, and then everyone's below it
        least, up = np.minimum(low[a], low[b]), low.copy()
        np.minimum.at(up, low[a], least)
        np.minimum.at(up, low[b], least)
        while not ((above := up[up]) == up).all():
            up = above
        if (up == low).all():
            break
        low = up
    name = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(name, low, (r * width + c)[order])
    out = np.empty(len(at), np.int64)
    out[order] = name[low]
    return out


#: Side of a tile, whose pixels are labelled in one task, and merged labels that are sent to all tasks.
TILE, SENT = 256, 100_000
#: Tile rows whose links are contracted together; their number is bounded by the scene's width.
BLOCK_TILES = 8


def _forest(names: list[str]):
    """Union-find over a partition's links (keys, x, y): for each label, the least that it reaches here."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[tuple, tuple] = {}

        def root(v: tuple) -> tuple:
            top = v
            while up.setdefault(top, top) != top:
                top = up[top]
            while up[v] != top:
                up[v], v = top, up[v]
            return top

        for p in parts:
            keys = list(zip(*[p[k] for k in names], strict=True))
            for key, x, y in zip(keys, p["x"].tolist(), p["y"].tolist(), strict=True):
                a, b = root((key, x)), root((key, y))
                if a != b:
                    up[max(a, b)] = min(a, b)
        found = [(*v[0], v[1], root(v)[1]) for v in up if root(v) != v]
        yield pd.DataFrame(found, columns=[*names, "x", "y"])

    return run


def components(mask: DataFrame, keys: list[str], width: int, conn: int = 4, tile: int = TILE) -> DataFrame:
    """keys, r, c, label of the pixels of a mask; mask has a row for each pixel that is set."""
    px = mask.select(*keys, F.col("r").cast("long"), F.col("c").cast("long"))
    tiled = lambda d: d.withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile))
    schema = T.StructType([*px.schema.fields, T.StructField("local", T.LongType())])

    def run(p: pa.Table, group: np.ndarray) -> pa.Table:
        return p.append_column("local", pa.array(_labels(p.column("r").to_numpy(), p.column("c").to_numpy(), group, tile, width, conn)))

    local = tiled(cut(map_tiles(tiled(px), [*keys, "tr", "tc"], run, schema)))
    edge = lambda v: F.pmod(F.col(v), F.lit(tile)).isin(0, tile - 1)
    border = local.where(edge("r") | edge("c"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in NEIGHBOURS[conn]]))
    moved = border.withColumn("_step", steps).select(*keys, (F.col("r") + F.col("_step.dr")).alias("r"), (F.col("c") + F.col("_step.dc")).alias("c"), F.col("local").alias("other"), F.col("tr").alias("tr2"), F.col("tc").alias("tc2"))
    met = border.join(moved, [*keys, "r", "c"]).where("(tr <> tr2 OR tc <> tc2) AND local <> other")
    pairs = met.select(*keys, F.greatest("local", "other").alias("x"), F.least("local", "other").alias("y")).distinct()
    block = F.floor(F.col("y") / (width * tile * BLOCK_TILES))
    near = pairs.repartition(*keys, block).mapInPandas(_forest(keys), pairs.schema)
    node = lambda v: F.struct(*keys, F.col(v).alias("local"))
    links = near.select(node("x").alias("a"), node("y").alias("b"))
    merged = stars(links).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.local").alias("local"), F.col("b.local").alias("merged"))
    merged = F.broadcast(merged) if merged.count() <= SENT else merged
    return local.join(merged, [*keys, "local"], "left").select(*keys, "r", "c", F.coalesce("merged", "local").alias("label"))


def regions(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """One row per region: n pixels, bounding box, centre."""
    ends = [f(c).alias(n) for f, c, n in ((F.min, "r", "r0"), (F.max, "r", "r1"), (F.min, "c", "c0"), (F.max, "c", "c1"))]
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("n"), *ends, F.avg("r").alias("cr"), F.avg("c").alias("cc"))


def remove_small(labelled: DataFrame, keys: list[str], least: int) -> DataFrame:
    big = labelled.groupBy(*keys, "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labelled.join(big, [*keys, "label"])
