"""Polygons to pixels by scan conversion, and zonal aggregates over a pyramid of tiles.

A polygon is an array of closed rings under the even-odd rule: parts, holes and islands in holes are rings alike. Each edge
is dealt to the pixel rows whose middle line it crosses; a row's sorted crossings, two by two, bound its spans of inside
pixels. A pixel belongs to a polygon if its centre does. So the work follows the lengths of outlines in rows, whatever
the areas, and nothing gathers a polygon or a scene in one task; a polygon's crossings of one row are a group of their own.

Where values are aggregated over polygons, spans that cover a tile of ``FACTOR`` x ``FACTOR`` pixels in all its rows become
spans of tiles, those of tiles again spans of larger tiles, and only what is left at each level is looked up there, in a
pyramid of aggregates. So the pixels that are read one by one follow the outlines, too. Spans and the pyramid's rows are
dealt by the place of a region of pixels, scenes and polygons in blocks, and a task adds up a block's spans over sorted
rows; what is shuffled are pixels and spans, never pairs of a polygon and a pixel.

Many scenes lie on one grid, and many polygons have equal rings. So spans are made once for each grid (``grids``) and, where
callers ask for it, once for each shape (``shapes``); sums over all scenes are made of pixels that are added up by grid first.

Scenes are tables of (keys, x0, y1, res, height, width): left and upper edge of pixel (0, 0), pixel size and extent.
Polygons are tables of (id, rings). Polygons with null or no rings, or outside all scenes, have no pixels. Rings that are not
closed are closed; degenerate rings bound nothing. Equal ids are taken together, as parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terradelta.checkpoints import cut
from terradelta.operators import spatial as SJ

#: Pixels, or tiles, along the side of a tile of the next level.
FACTOR = 8
#: What a scene's grid is; scenes and polygons' spans of a grid that are added up together; rows that are sent to all tasks.
GRID = ["x0", "y1", "res", "height", "width"]
SCENES, SPANS, SENT = 16, 100_000, 100_000


def near(table: DataFrame, most: int = SENT) -> DataFrame:
    """A table that is kept already, sent to all tasks where it is small."""
    return F.broadcast(table) if table.count() <= most else table


def grids(scenes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(_grid and the columns of ``GRID``) of the distinct grids, and (keys, _grid) of the scenes."""
    own = cut(scenes.select(*keys, *GRID))
    each = cut(own.select(*GRID).distinct().withColumn("_grid", F.monotonically_increasing_id()))
    return each, near(cut(own.join(each, GRID).select(*keys, "_grid")))


def shapes(polygons: DataFrame, id_col: str, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """(id, _shape) of each polygon, and (_shape, rings) of those that stand for all with equal rings, the ones of least id."""
    row = F.sha2(F.col(rings).cast("string").cast("binary"), 256)
    signed = polygons.where(F.col(rings).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("_rings"))
    members = cut(signed.join(signed.groupBy("_rings").agg(F.min(id_col).alias("_shape")), "_rings").select(id_col, "_shape"))
    own = polygons.join(members.where(F.col(id_col) == F.col("_shape")).select(id_col), id_col, "left_semi")
    return members, own.select(F.col(id_col).alias("_shape"), F.col(rings).alias("rings"))


def edges(polygons: DataFrame, id_col: str, rings: str = "rings") -> DataFrame:
    """(id, x1, y1, x2, y2) of all rings; level edges, which cross no row, go."""
    ring = polygons.select(id_col, F.explode(rings).alias("ring")).where(F.size("ring") > 2)
    point = ring.select(id_col, F.concat("ring", F.slice("ring", 1, 1)).alias("p"))
    n = F.size("p")
    pair = F.arrays_zip(F.slice("p", F.lit(1), n - 1).alias("a"), F.slice("p", F.lit(2), n - 1).alias("b"))
    each = point.select(id_col, F.explode(pair).alias("e")).select(id_col, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return each.where("y1 <> y2")


def boxes(polygons: DataFrame, id_col: str, rings: str = "rings") -> DataFrame:
    """(id, xmin, ymin, xmax, ymax) of each polygon."""
    points = F.flatten(rings)
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    ends = [F.min(F.array_min(x)).alias("xmin"), F.min(F.array_min(y)).alias("ymin"), F.max(F.array_max(x)).alias("xmax"), F.max(F.array_max(y)).alias("ymax")]
    return polygons.groupBy(id_col).agg(*ends).where("xmin IS NOT NULL")


def scene_boxes(scenes: DataFrame) -> DataFrame:
    return scenes.withColumns({"xmin": F.col("x0"), "xmax": F.col("x0") + F.col("width") * F.col("res"), "ymin": F.col("y1") - F.col("height") * F.col("res"), "ymax": F.col("y1")})


def spans(polygons: DataFrame, scenes: DataFrame, id_col: str, keys: list[str], rings: str = "rings", cell: float = SJ.CELL) -> DataFrame:
    """(id, keys, r, c0, c1): runs of a row's pixels whose centres lie in the polygon, both ends included."""
    named = scene_boxes(scenes).withColumn("_scene", F.struct(*keys))
    met = SJ.box_pairs(boxes(polygons, id_col, rings), named, id_col, "_scene", cell=cell, more=("x0", "y1", "res", "height", "width")).select(id_col, "_scene", "x0", F.col("y1").alias("top"), "res", "height", "width")
    line = edges(polygons, id_col, rings).join(met, id_col)
    row = lambda y: (F.col("top") - y) / F.col("res") - 0.5  # noqa: E731  where a height lies, in rows
    first = F.greatest(F.floor(row(F.greatest("y1", "y2"))) + 1, F.lit(0).cast("long"))
    last = F.least(F.floor(row(F.least("y1", "y2"))), F.col("height").cast("long") - 1)
    crossed = line.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("r", F.explode(F.sequence("first", "last")))
    y = F.col("top") - (F.col("r") + 0.5) * F.col("res")
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    # the first column at or behind the crossing
    column = F.ceil((x - F.col("x0")) / F.col("res") - 0.5)
    turns = crossed.select(id_col, "_scene", "r", F.least(F.greatest(column, F.lit(0).cast("long")), F.col("width").cast("long")).alias("c"))
    odd = turns.groupBy(id_col, "_scene", "r", "c").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    w = Window.partitionBy(id_col, "_scene", "r").orderBy("c")
    paired = odd.select(id_col, "_scene", "r", F.col("c").alias("c0"), (F.lead("c").over(w) - 1).alias("c1"), F.row_number().over(w).alias("k"))
    return paired.where("k % 2 = 1 AND c0 <= c1").select(id_col, *[F.col(f"_scene.{k}").alias(k) for k in keys], "r", "c0", "c1")


def cells(runs: DataFrame) -> DataFrame:
    """A row for each pixel, or tile, of spans: (..., r, c)."""
    return runs.withColumn("c", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def burn(polygons: DataFrame, scenes: DataFrame, keys: list[str], rings: str = "rings", value: str | None = None) -> DataFrame:
    """(keys, r, c, v): pixels whose centres lie in some polygon, with the largest of the polygons' values (1 without)."""
    each, placed = grids(scenes, keys)
    hit = burn_grids(polygons, each, rings, value)
    return hit.join(placed, "_grid").select(*keys, "r", "c", "v")


def burn_grids(polygons: DataFrame, each: DataFrame, rings: str = "rings", value: str | None = None) -> DataFrame:
    """(_grid, r, c, v): as ``burn``, once for the pixels of all scenes of a grid. Equal rings without a value burn once."""
    own = polygons.select(F.col(rings).alias("rings")).distinct().withColumn("_id", F.monotonically_increasing_id()) if value is None else polygons.select(F.col(rings).alias("rings"), F.col(value).alias("_id"))
    hit = cells(spans(cut(own) if value is None else own, each, "_id", ["_grid"]))
    if value is None:
        return hit.select("_grid", "r", "c").distinct().withColumn("v", F.lit(1))
    return hit.groupBy("_grid", "r", "c").agg(F.max("_id").alias("v"))


def burnt(px: DataFrame, scenes: DataFrame, keys: list[str], layers: dict[str, Callable[[DataFrame], DataFrame]], most: int = 1_000_000) -> DataFrame:
    """The pixels, with a boolean for each layer: it has the pixel of the scene's grid. layers: functions of the distinct grids
    that give (_grid, r, c). A grid's pixels are one small table for all its scenes, sent to the tasks up to ``most`` rows."""
    each, placed = grids(scenes, keys)
    out = px.join(placed, keys)
    for name, layer in layers.items():
        hit = cut(layer(each).select("_grid", "r", "c"))
        out = out.join(near(hit.withColumn(name, F.lit(True)), most), ["_grid", "r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("_grid").select(*px.columns, *layers)


def burn_lines(lines: DataFrame, scenes: DataFrame, keys: list[str], cell: float = SJ.CELL) -> DataFrame:
    """(keys, r, c): pixels along segments (x1, y1, x2, y2): one in each column of a flat segment, one in each row of a steep
    one, the nearest to it, from the pixel of its one end to that of the other."""
    own = lines.select("x1", "y1", "x2", "y2").distinct().withColumn("_id", F.monotonically_increasing_id()).withColumns({"xmin": F.least("x1", "x2"), "ymin": F.least("y1", "y2"), "xmax": F.greatest("x1", "x2"), "ymax": F.greatest("y1", "y2")})
    named = scene_boxes(scenes).withColumn("_scene", F.struct(*keys)).withColumnRenamed("y1", "top")
    met = SJ.box_pairs(own, named, "_id", "_scene", cell=cell, more=("x0", "top", "res", "height", "width"))
    column, row = lambda x: (F.col(x) - F.col("x0")) / F.col("res"), lambda y: (F.col("top") - F.col(y)) / F.col("res")
    placed = met.select("_scene", "height", "width", *[f(a).alias(n) for f, a, n in ((column, "x1", "ca"), (column, "x2", "cb"), (row, "y1", "ra"), (row, "y2", "rb"))])
    flat = F.abs(F.col("cb") - F.col("ca")) >= F.abs(F.col("rb") - F.col("ra"))
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    ends = placed.select("_scene", "height", "width", flat.alias("flat"), pick("ca", "ra").alias("a"), pick("cb", "rb").alias("b"), pick("ra", "ca").alias("va"), pick("rb", "cb").alias("vb"))
    most = F.when(F.col("flat"), F.col("width")).otherwise(F.col("height")).cast("long") - 1
    first, last = F.greatest(F.floor(F.least("a", "b")), F.lit(0).cast("long")), F.least(F.floor(F.greatest("a", "b")), most)
    steps = ends.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    share = F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.least(F.greatest(F.col("i") + 0.5, F.least("a", "b")), F.greatest("a", "b")) - F.col("a")) / (F.col("b") - F.col("a")))
    across = F.floor(F.col("va") + share * (F.col("vb") - F.col("va")))
    at = steps.withColumn("across", across).select("_scene", "height", "width", F.when(F.col("flat"), F.col("across")).otherwise(F.col("i")).alias("r"), F.when(F.col("flat"), F.col("i")).otherwise(F.col("across")).alias("c"))
    inside = at.where("r >= 0 AND r < height AND c >= 0 AND c < width")
    return inside.select(*[F.col(f"_scene.{k}").alias(k) for k in keys], "r", "c").distinct()


def coarsen(runs: DataFrame, by: list[str], factor: int = FACTOR) -> tuple[DataFrame, DataFrame]:
    """(full, rest) of disjoint spans (by, r, c0, c1): spans of tiles that all rows of a tile row cover, with r, c0 and c1
    in tiles, and the spans of what they leave.

    A tile row's spans open and close at whole tiles; where as many are open as the tile has rows, tiles are full.
    """
    step = F.lit(factor).cast("long")
    whole = runs.select(*by, F.floor(F.col("r") / step).alias("r"), F.ceil(F.col("c0") / step).alias("a"), F.floor((F.col("c1") + 1) / step).alias("b")).where("a < b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("d")), F.struct(F.col("b").alias("c"), F.lit(-1).alias("d")))).alias("e")
    events = whole.select(*by, "r", ends).groupBy(*by, "r", F.col("e.c").alias("c")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*by, "r").orderBy("c")
    depth = events.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("c").over(w))
    full = depth.where(F.col("depth") == factor).select(*by, "r", F.col("c").alias("c0"), (F.col("next") - 1).alias("c1"))
    # each row's spans less the full tiles' columns, as changes of a depth of 0 or 1
    change = lambda d, at, by_: d.select(*by, "r", F.explode(F.array(F.struct(at[0].alias("c"), F.lit(by_).alias("d")), F.struct(at[1].alias("c"), F.lit(-by_).alias("d")))).alias("e"))
    rows = full.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), step - 1))).withColumn("r", F.col("r") * step + F.col("k"))
    both = change(runs, (F.col("c0"), F.col("c1") + 1), 1).unionByName(change(rows, (F.col("c0") * step, (F.col("c1") + 1) * step), -1))
    left = both.groupBy(*by, "r", F.col("e.c").alias("c")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    open_ = left.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("c").over(w))
    return full, open_.where("depth = 1").select(*by, "r", F.col("c").alias("c0"), (F.col("next") - 1).alias("c1"))


def pyramid(px: DataFrame, keys: list[str], sums: dict[str, Column], classes: list[str] = (), levels: int = 2, factor: int = FACTOR) -> DataFrame:
    """(level, keys, r, c, classes, sums): sums of the pixels of each tile of each level, 0 for pixels themselves. Columns in
    ``classes`` split a tile's sums, for histograms. Each level is added up from the one below."""
    own = [*keys, "r", "c", *classes]
    at = px.groupBy(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *classes).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    out = at.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        tile = lambda v: F.floor(F.col(v) / factor).alias(v)
        at = at.groupBy(*keys, tile("r"), tile("c"), *classes).agg(*[F.sum(n).alias(n) for n in sums])
        out = out.unionByName(at.withColumn("level", F.lit(level)))
    return out.select("level", *own, *sums)


def level_runs(runs: DataFrame, by: list[str], levels: int = 2, factor: int = FACTOR) -> DataFrame:
    """(level, by, r, c0, c1): spans as the fewest tiles of a pyramid, those of a row side by side as one. Each level's spans
    are kept, as two results are made of them."""
    out = None
    for level in range(levels + 1):
        runs = cut(runs) if level < levels else runs
        full, rest = coarsen(runs, by, factor) if level < levels else (None, runs)
        here = rest.withColumn("level", F.lit(level))
        out = here if out is None else out.unionByName(here)
        runs = full
    return out.select("level", *by, "r", "c0", "c1")


def levelled(runs: DataFrame, by: list[str], levels: int = 2, factor: int = FACTOR) -> DataFrame:
    """(level, by, r, c): the fewest tiles of a pyramid that make up spans."""
    return cells(level_runs(runs, by, levels, factor)).select("level", *by, "r", "c")


def _adder(names: list[str], layer: list[str], sums: list[str], side: int):
    """Sums of a block of spans (names[0], level, r, c0, c1) over a block of a pyramid's rows (level, layer, r, c, sums), of one
    region; r and c count from the region's corner. Spans of one shape are added up; a sum of nulls only is null."""

    def place(t: pa.Table, c: str) -> np.ndarray:
        level, r, at = (t.column(k).to_numpy().astype(np.int64) for k in ("level", "r", c))
        return (level * side + r) * side + at

    def run(px: pa.Table, spans: pa.Table) -> pa.Table:
        found = {k: [] for k in names}
        if px.num_rows and spans.num_rows:
            group = px.select(layer).to_pandas().groupby(layer, sort=False, dropna=False).ngroup().to_numpy() if layer else np.zeros(px.num_rows, np.int64)
            order = np.lexsort((place(px, "c"), group))
            group, at = group[order], place(px, "c")[order]
            ids, whose = np.unique(spans.column("_id").combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
            by = np.argsort(whose, kind="stable")
            first, last, whose = place(spans, "c0")[by], place(spans, "c1")[by], whose[by]
            sample = by[np.searchsorted(whose, np.arange(len(ids)))]  # a row of each shape
            values = {k: px.column(k).combine_chunks().take(pa.array(order)) for k in sums}
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=True):
                lo, hi = np.searchsorted(at[a:b], first), np.searchsorted(at[a:b], last, "right")
                some = hi > lo
                if not some.any():
                    continue
                ends = np.stack([lo[some], hi[some]], 1).ravel()
                start = np.flatnonzero(np.r_[True, np.diff(whose[some]) > 0])
                total = lambda v: np.add.reduceat(np.add.reduceat(np.append(v, v[:1] * 0), ends)[::2], start)  # noqa: B023, E731
                met = whose[some][start]
                found["_id"].append(spans.column("_id").take(pa.array(sample[met])).combine_chunks())
                one = pa.array(np.full(len(met), order[a]))
                for k in layer:
                    found[k].append(px.column(k).take(one).combine_chunks())
                for k in sums:
                    own = values[k].slice(a, b - a)
                    known = None if own.null_count == 0 else total(own.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)) > 0
                    each = own.fill_null(0) if own.null_count else own
                    found[k].append(pa.array(total(each.to_numpy(zero_copy_only=False)), own.type, mask=None if known is None else ~known))
        types = {"_id": spans.schema.field("_id").type, **{k: px.schema.field(k).type for k in [*layer, *sums]}}
        return pa.table({k: pa.chunked_array(found[k], types[k]) for k in names})

    return run


def zonal(polygons: DataFrame, px: DataFrame, scenes: DataFrame, id_col: str, keys: list[str], sums: dict[str, Column], classes: list[str] = (), rings: str = "rings", levels: int = 2, stacked: bool = False) -> DataFrame:
    """(id, keys, classes, sums) over the pixels whose centres lie in each polygon; stacked: without keys, over all scenes."""
    each, placed = grids(scenes, keys)
    over, classes, named = [] if stacked else keys, list(classes), list(sums)
    layer = [*over, *classes]
    runs = cut(level_runs(spans(polygons, each, id_col, ["_grid"], rings), [id_col, "_grid"], levels).withColumnRenamed(id_col, "_id"))
    # blocks of scenes and of polygons
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1).cast("long"))
    many = placed.groupBy("_grid").agg((F.lit(1).cast("long") if stacked else blocks(F.count("*"), SCENES)).alias("_b"))
    sizes = near(cut(many.join(runs.groupBy("_grid").agg(blocks(F.count("*"), SPANS).alias("_w")), "_grid")))
    # a region's side in pixels, and in tiles of each level
    side = 4 * FACTOR**levels
    per = F.element_at(F.array(*[F.lit(side // FACTOR**k).cast("long") for k in range(levels + 1)]), F.col("level") + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = pyramid(px.join(placed, keys), ["_grid", *over], sums, classes, levels).join(sizes, "_grid")
    dealt = own.withColumns({"_tr": F.floor(F.col("r") / per), "_tc": F.floor(F.col("c") / per), "_u": F.pmod(F.xxhash64(*over), "_b") if over else F.lit(0).cast("long")}).withColumn("_v", every("_w"))
    region = ["_grid", "_tr", "_tc", "_u", "_v"]
    left = dealt.select(*region, "level", (F.col("r") - F.col("_tr") * per).alias("r"), (F.col("c") - F.col("_tc") * per).alias("c"), *layer, *named)
    across = F.explode(F.sequence(F.floor(F.col("c0") / per), F.floor(F.col("c1") / per)))
    split = runs.join(sizes, "_grid").withColumns({"_tr": F.floor(F.col("r") / per), "_v": F.pmod(F.xxhash64("_id"), "_w")}).withColumn("_tc", across).withColumn("_u", every("_b"))
    at = F.col("_tc") * per
    right = split.select(*region, "level", "_id", (F.col("r") - F.col("_tr") * per).alias("r"), F.greatest(F.col("c0") - at, F.lit(0).cast("long")).alias("c0"), F.least(F.col("c1") - at, per - 1).alias("c1"))
    names = ["_id", *layer, *named]
    fields = {f.name: f for d in (right, left) for f in d.schema.fields}
    added = left.groupBy(*region).cogroup(right.groupBy(*region)).applyInArrow(_adder(names, layer, named, side), T.StructType([fields[k] for k in names]))
    return added.groupBy(F.col("_id").alias(id_col), *layer).agg(*[F.sum(n).alias(n) for n in named])
