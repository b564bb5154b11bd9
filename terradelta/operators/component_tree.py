"""Component trees: the regions of a raster at all thresholds at once.

Regions at a lower threshold contain those at a higher one, so all of them are the nodes of a tree: a node is a region at
its level, its parent the region that it becomes part of further down. Links between neighbours are taken by falling level
(the lower of the two), and a union-find over them builds the tree; a pixel then asks how far down it must go until its
region has a given size, which answers every threshold without labelling once more.

Tiles are done first, each by itself. A node without a pixel on its tile's border can meet nothing outside: its size is
final. The others go on, as vertices that stand for all their pixels, with the links across borders: blocks of ``GROUP`` x
``GROUP`` tiles are merged by the same step, then blocks of blocks, until no link is left. So a task holds a tile, or the
open nodes along the borders within a block, and the number of rounds follows the logarithm of a scene's size. What a
round could not answer is looked up in the round above by the first open node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terradelta.checkpoints import cut
from terradelta.operators.components import NEIGHBOURS

#: Tiles, or blocks, along the side of a block.
GROUP = 8
#: Stands for a size that only a round above knows.
LATER = -1


def build(level: list[int], own: list[int], links: list[tuple[int, int]], open_: list[bool], areas: list[int]) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """For each vertex: its node (a vertex of the same level), the pixels that the node stands for (its own and those of
    closed regions above it), its parent node (-1 for none), whether the node is open, its first open node upwards (-1 for none), and for each area the highest level at which its region
    has that size: 0 for none, ``LATER`` where that is up to the open node. A vertex stands for ``own`` pixels of its level."""
    n = len(level)
    up, same, parent, count, opened = list(range(n)), list(range(n)), [-1] * n, list(own), list(open_)
    top = list(range(n))  # of each set: its lowest node

    def find(a: list[int], x: int) -> int:
        while a[x] != x:
            a[x] = x = a[a[x]]
        return x

    for x, y in sorted(links, key=lambda e: -min(level[e[0]], level[e[1]])):
        a, b = find(up, x), find(up, y)
        if a == b:
            continue
        one, two = top[a], top[b]
        if level[one] < level[two]:
            one, two = two, one
        if level[one] == level[two]:  # one node
            same[one] = two
            count[two] += count[one]
            opened[two] |= opened[one]
        else:
            parent[one] = two
        up[a] = b
        top[b] = two
    nodes = sorted({find(same, v) for v in range(n)}, key=lambda v: -level[v])
    size = list(count)
    for v in nodes:  # from the highest level down
        if parent[v] >= 0:
            above = parent[v] = find(same, parent[v])
            size[above] += size[v]
            opened[above] |= opened[v]
            if not opened[v]:
                count[above] += size[v]
    first, reach = [-1] * n, [[]] * n
    for v in reversed(nodes):
        above = parent[v]
        if opened[v]:
            first[v], reach[v] = v, [LATER] * len(areas)
        else:
            first[v] = first[above] if above >= 0 else -1
            reach[v] = [level[v] if size[v] >= a else reach[above][k] if above >= 0 else 0 for k, a in enumerate(areas)]
    return [(v, count[v], parent[v], opened[v], first[v], reach[v]) for v in (find(same, x) for x in range(n))]


def _grid_links(r: np.ndarray, c: np.ndarray, conn: int) -> list[tuple[int, int]]:
    """Pairs of neighbouring pixels, by their places in the arrays."""
    r0, c0 = r.min(), c.min()
    grid = np.full((r.max() - r0 + 2, c.max() - c0 + 3), -1, np.int64)
    grid[r - r0, c - c0 + 1] = np.arange(len(r))
    out = []
    for a, b in NEIGHBOURS[conn]:
        one, two = grid[: grid.shape[0] - 1, 1:-1], grid[a : grid.shape[0] - 1 + a, 1 + b : grid.shape[1] - 1 + b]
        both = (one >= 0) & (two >= 0)
        out += zip(one[both].tolist(), two[both].tolist(), strict=True)
    return out


_NODE = "level int, node long, own long, parent long, open boolean, first long, reach array<int>"


def _tile(keys: list[str], width: int, conn: int, tile: int, areas: list[int]):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        r, c, level = p["r"].to_numpy(), p["c"].to_numpy(), p["level"].tolist()
        edge = np.isin(r % tile, (0, tile - 1)) | np.isin(c % tile, (0, tile - 1))
        found = build(level, [1] * len(p), _grid_links(r, c, conn), edge.tolist(), areas)
        return _named(p[[*keys, "r", "c", "tr", "tc", "level"]], (r * width + c).tolist(), found)

    return run


def _named(p: pd.DataFrame, names: list[int], found: list[tuple]) -> pd.DataFrame:
    name = lambda k: [names[f[k]] if f[k] >= 0 else None for f in found]
    columns = {"node": name(0), "own": [f[1] for f in found], "parent": name(2), "open": [f[3] for f in found], "first": name(4)}
    return p.assign(**{k: pd.Series(v, index=p.index, dtype="boolean" if k == "open" else "Int64") for k, v in columns.items()}, reach=[f[5] for f in found])


def _merge(keys: list[str], areas: list[int]):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = p[p["kind"] == 0]
        names, level = v["x"].tolist(), v["level"].tolist()
        at = {x: k for k, x in enumerate(names)}
        links = [(at[x], at[int(y)]) for x, y in zip(names, v["y"].tolist(), strict=True) if pd.notna(y)]  # nodes and parents
        e = p[p["kind"] == 1]
        links += [(at[x], at[int(y)]) for x, y in zip(e["x"].tolist(), e["y"].tolist(), strict=True)]
        marks = set(p.loc[p["kind"] == 2, "x"].tolist())
        found = build(level, v["own"].tolist(), links, [x in marks for x in names], areas)
        return _named(v[[*keys, "tr", "tc", "x", "level"]], names, found)

    return run


def reaches(px: DataFrame, keys: list[str], areas: list[int], width: int, conn: int = 4, tile: int = 32) -> DataFrame:
    """(keys, r, c, level, reach) of pixels with a level above 0: reach[k] is the highest level, at most the pixel's own, at
    which the pixel's region (its neighbours of that level or more, and so on) has areas[k] pixels or more; 0 for none.

    px: keys, r, c and a whole-number level; one row for each pixel. width: above the largest c.
    """
    key_fields = T.StructType([f for f in px.schema.fields if f.name in keys])
    schema = lambda more: T.StructType([*key_fields.fields, *T._parse_datatype_string(f"{more}, tr long, tc long, {_NODE}").fields])
    placed = px.where("level > 0").select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("level").cast("int").alias("level"))
    tiles = placed.withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile))
    order = [*keys, "r", "c", "tr", "tc", "level", "node", "own", "parent", "open", "first", "reach"]
    pixels = cut(tiles.groupBy(*keys, "tr", "tc").applyInPandas(lambda p: _tile(keys, width, conn, tile, areas)(p)[order], T.StructType([schema("r long, c long")[f] for f in order])))
    edge = lambda v: F.pmod(F.col(v), F.lit(tile)).isin(0, tile - 1)
    border = pixels.where(edge("r") | edge("c")).select(*keys, "r", "c", "tr", "tc", "node", "level")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in NEIGHBOURS[conn]]))
    moved = border.withColumn("_step", steps).select(*keys, (F.col("r") + F.col("_step.dr")).alias("r"), (F.col("c") + F.col("_step.dc")).alias("c"), F.col("tr").alias("tr2"), F.col("tc").alias("tc2"), F.col("node").alias("y"), F.col("level").alias("level2"))
    met = border.join(moved, [*keys, "r", "c"]).where("tr <> tr2 OR tc <> tc2")
    # of the links between two nodes the highest does
    links = met.groupBy(*keys, F.col("node").alias("x"), "y", "tr", "tc", "tr2", "tc2").agg(F.max(F.least("level", "level2")).alias("w"))
    links = cut(links)
    nodes = pixels.where((F.col("node") == F.col("r") * width + F.col("c")) & F.col("open")).select(*keys, "tr", "tc", F.col("node").alias("x"), "level", "own", F.col("parent").alias("y"))
    rounds = []
    name = [*keys, "tr", "tc", "x", "level", "node", "own", "parent", "open", "first", "reach"]
    while True:
        block = lambda v: F.floor(F.col(v) / GROUP).alias(v)
        nodes = nodes.select(*keys, block("tr"), block("tc"), "x", "level", "own", "y")
        links = links.select(*keys, "x", "y", "w", *[block(v) for v in ("tr", "tc", "tr2", "tc2")])
        inner = (F.col("tr") == F.col("tr2")) & (F.col("tc") == F.col("tc2"))
        outer = links.where(~inner)
        none = lambda kind, name_: F.lit(None).cast(kind).alias(name_)
        marks = outer.select(*keys, "tr", "tc", "x").union(outer.select(*keys, "tr2", "tc2", "y")).distinct()
        rows = nodes.select(*keys, "tr", "tc", F.lit(0).alias("kind"), "x", "level", "own", "y")
        rows = rows.union(links.where(inner).select(*keys, "tr", "tc", F.lit(1), "x", none("int", "level"), none("long", "own"), "y"))
        rows = rows.union(marks.select(*keys, "tr", "tc", F.lit(2), "x", none("int", "level"), none("long", "own"), none("long", "y")))
        merged = cut(rows.groupBy(*keys, "tr", "tc").applyInPandas(lambda p: _merge(keys, areas)(p)[name], T.StructType([schema("x long")[f] for f in name])))
        rounds.append(merged.select(*keys, "x", "first", "reach"))
        if outer.isEmpty():
            break
        now = merged.select(*keys, "x", "node")
        renamed = outer.join(now, [*keys, "x"]).drop("x").withColumnRenamed("node", "x")
        renamed = renamed.join(now.withColumnRenamed("x", "y"), [*keys, "y"]).drop("y").withColumnRenamed("node", "y")
        links = cut(renamed.groupBy(*keys, "x", "y", "tr", "tc", "tr2", "tc2").agg(F.max("w").alias("w")))
        nodes = merged.where((F.col("node") == F.col("x")) & F.col("open")).select(*keys, "tr", "tc", "x", "level", "own", F.col("parent").alias("y"))
    known = pixels.select(*keys, "r", "c", "level", "first", "reach")
    for merged in rounds:
        further = merged.select(*keys, F.col("x").alias("first"), F.col("first").alias("next"), F.col("reach").alias("more"))
        known = known.join(further, [*keys, "first"], "left")
        known = known.select(*keys, "r", "c", "level", F.col("next").alias("first"), F.when(F.col("more").isNull(), F.col("reach")).otherwise(F.zip_with("reach", "more", lambda a, b: F.when(a == LATER, b).otherwise(a))).alias("reach"))
    return known.select(*keys, "r", "c", "level", "reach")


def level_of(value: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds a value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= value))


def area_sweep(px: DataFrame, keys: list[str], value: str, gt: str, thresholds: list[float], areas: list[int], width: int, ignore: int = 255, conn: int = 4) -> DataFrame:
    """(thr, min_area, tp, fp, fn) for each threshold and least area: a pixel counts as found where its region at the
    threshold has the area. Ignored pixels belong to regions, but are not counted. Pixels are read once; a pixel's highest
    level for an area, a number, decides for all thresholds, so sums run over a histogram."""
    levels = px.withColumn("level", level_of(F.col(value), thresholds))
    found = reaches(levels, keys, areas, width, conn)
    # a pixel's own region holds it: with an area of 1, reach is its level
    rated = px.where(F.col(gt) != ignore).select(*keys, "r", "c", (F.col(gt) == 1).alias("hit")).join(found, [*keys, "r", "c"], "left")
    zero = F.array(*[F.lit(0)] * len(areas))
    each = rated.select("hit", F.posexplode(F.coalesce("reach", zero)).alias("k", "reach"))
    hist = each.groupBy("k", "reach").agg(F.count(F.when(F.col("hit"), 1)).alias("tp"), F.count(F.when(~F.col("hit"), 1)).alias("fp"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(thresholds)))).alias("reach")
    every = px.sparkSession.range(len(areas)).select(F.col("id").cast("int").alias("k"), steps)
    w = Window.partitionBy("k").orderBy(F.col("reach").desc())
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    sums = every.join(hist, ["k", "reach"], "left").select("k", "reach", total("tp").alias("tp"), total("fp").alias("fp"), F.sum(F.coalesce("tp", F.lit(0))).over(Window.partitionBy("k")).alias("positive"))
    named = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at)
    return sums.where("reach > 0").select(named(thresholds, F.col("reach")).alias("thr"), named(areas, F.col("k") + 1).alias("min_area"), "tp", "fp", (F.col("positive") - F.col("tp")).alias("fn"))
