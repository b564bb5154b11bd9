"""Spatial joins by grid cells of several sizes.

A box has a level, the least at which a cell is as long as the box; so at its own level or a coarser one it covers four
cells at most, however large it is. Boxes are listed under their cells at each level that is some box's, from their own on;
equal cells of the coarser of two boxes' levels join by hash, and a pair counts only in the cell of the lower left corner of
the boxes' common part, so that no pair appears twice and none needs a distinct. Cells hold what lies near, so the join
spreads with the data; Spark splits crowded cells (AQE skew join). No join is a cross join; the levels, a few dozen numbers
at most, are known to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 1000.0


def _level(cell: float, buffer: float = 0.0) -> Column:
    longest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) + 2 * buffer
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(1e-9)) / cell))).cast("int")


def _levels(df: DataFrame, cell: float, buffer: float = 0.0) -> list[int]:
    return sorted(r[0] for r in df.select(_level(cell, buffer)).distinct().collect() if r[0] is not None)


def _celled(df: DataFrame, levels: list[int], cell: float, buffer: float = 0.0) -> DataFrame:
    """The boxes under (level, cx, cy), with their own level as _own. levels: those of the boxes that they may meet; a pair
    counts at the coarser of its two levels, so a box is listed at these beyond its own, and at its own if some is not."""
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    lo = lambda c: F.floor((F.col(c) - buffer) / size)
    hi = lambda c: F.floor((F.col(c) + buffer) / size)
    every, none = F.array(*[F.lit(x) for x in levels]).cast("array<int>"), F.array().cast("array<int>")
    own = F.when(F.col("_own") >= F.array_min(every), F.array("_own")).otherwise(none)
    each = df.withColumn("_own", _level(cell, buffer)).withColumn("level", F.explode(F.concat(own, F.filter(every, lambda x: x > F.col("_own")))))
    return each.withColumn("cx", F.explode(F.sequence(lo("xmin"), hi("xmax")))).withColumn("cy", F.explode(F.sequence(lo("ymin"), hi("ymax"))))


_NAMES = ("xmin", "ymin", "xmax", "ymax")


def _sides(left: DataFrame, right: DataFrame, cell: float, buffer: float) -> tuple[DataFrame, DataFrame]:
    """Both sides under their cells; the right one's box and cell are named r_..."""
    mine, theirs = _levels(left, cell, buffer), _levels(right, cell)
    b = _celled(right, mine, cell)
    return _celled(left, theirs, cell, buffer), b.select(*[c for c in right.columns if c not in _NAMES], *[F.col(c).alias(f"r_{c}") for c in _NAMES], F.col("_own").alias("_r_own"), *[F.col(c).alias(f"_r_{c}") for c in ("level", "cx", "cy")])


def _same_cell(buffer: float) -> Column:
    cell = (F.col("level") == F.col("_r_level")) & (F.col("cx") == F.col("_r_cx")) & (F.col("cy") == F.col("_r_cy"))
    return cell & (F.col("xmin") - buffer <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("xmax") + buffer) & (F.col("ymin") - buffer <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("ymax") + buffer)


def box_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float = CELL, buffer: float = 0.0, exact: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, ...) of intersecting closed boxes; ``buffer`` widens the left boxes; ``exact``: a further
    condition on the left box's columns and ``more`` columns of the right. cell: the finest cells' length."""
    a, b = _sides(left, right.select(right_id, *more, *_NAMES), cell, buffer)
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    corner = lambda lo: F.floor(F.greatest(F.col(lo) - buffer, F.col(f"r_{lo}")) / size)
    once = (F.col("level") == F.greatest("_own", "_r_own")) & (corner("xmin") == F.col("cx")) & (corner("ymin") == F.col("cy"))
    pairs = a.join(b, _same_cell(buffer) & once).drop("_own", "_r_own", "level", "_r_level", "_r_cx", "_r_cy")
    return pairs.where(exact) if exact else pairs


def met(left: DataFrame, right: DataFrame, cell: float = CELL, buffer: float = 0.0, exact: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(xmin, ymin, xmax, ymax): the distinct boxes of the left side that meet some box of the right one; options as of
    ``box_pairs``. Equal boxes are asked for once and looked at once, and a box's search ends with the first that it meets, so
    there are no pairs to be made."""
    a, b = _sides(left.select(*_NAMES).distinct(), right.select(*more, *_NAMES).distinct(), cell, buffer)
    condition = _same_cell(buffer)
    return a.join(b, condition & F.expr(exact) if exact else condition, "left_semi").select(*_NAMES).distinct()


def flag_met(left: DataFrame, boxes: DataFrame, name: str) -> DataFrame:
    """The left rows with a boolean: their box is one of these; false where it has a null."""
    return left.join(boxes.select(*_NAMES, F.lit(True).alias(name)), list(_NAMES), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def flag(left: DataFrame, pairs: DataFrame, left_id: str, name: str) -> DataFrame:
    """The left rows with a boolean: has a pair."""
    return left.join(pairs.select(left_id, F.lit(True).alias(name)).distinct(), left_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def count(left: DataFrame, pairs: DataFrame, left_id: str, name: str) -> DataFrame:
    n = pairs.groupBy(left_id).agg(F.count("*").alias(name))
    return left.join(n, left_id, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def footprints(px: DataFrame, keys: list[str], x0: Column, y1: Column, res: float, crs: str, lon: str, lat: str) -> DataFrame:
    """keys, crs, the box of each scene's pixels, and the WGS84 box of that box's corners; x0 and y1 are the left and upper
    edge of pixel (0, 0), lon and lat expression texts over x and y. An error if there is no scene."""
    ends = px.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    if ends.isEmpty():
        raise ValueError("no raster found")
    box = ends.select(*keys, F.lit(crs).alias("crs"), (x0 + F.col("c0") * res).alias("xmin"), (y1 - (F.col("r1") + 1) * res).alias("ymin"), (x0 + (F.col("c1") + 1) * res).alias("xmax"), (y1 - F.col("r0") * res).alias("ymax"))
    corners = F.explode(F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a in ("xmin", "xmax") for b in ("ymin", "ymax")])).alias("p")
    own = [*keys, "crs", "xmin", "ymin", "xmax", "ymax"]
    at = box.select(*own, corners).select(*own, "p.x", "p.y").select(*own, F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))
    return at.groupBy(*own).agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"), F.max("lon").alias("lon1"), F.max("lat").alias("lat1"))
