"""Pixel and window operators on tables with a row per pixel (r, c) of a scene or chip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.operators.quantiles import quantiles

#: Structuring elements (fixed values).
ELEMENTS = {
    "square2": [(0, 0), (0, 1), (1, 0), (1, 1)],
    "square3": [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)],
    "square5": [(a, b) for a in range(-2, 3) for b in range(-2, 3)],
    "ellipse3": [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)],
    "ellipse7": [(a, b) for a in range(-3, 4) for b in range(-3, 4) if abs(b) <= round((9 - a * a) ** 0.5)],
}


def reflected(element: str) -> list[tuple[int, int]]:
    return [(-a, -b) for a, b in ELEMENTS[element]]


def focal(px: DataFrame, keys: list[str], value: str, element: str | list[tuple[int, int]], aggs: list[Column], tile: int = 64) -> DataFrame:
    """Aggregates of each pixel's neighbourhood; element: a name in ``ELEMENTS`` or its offsets.

    Pixels are dealt by tile, those near a tile's border to the neighbouring tiles too, and only inside a tile is each
    pixel listed under the pixels around it; so the one shuffle moves little more than the pixels themselves. Pixels
    that are not in the table, beyond an edge or missing, take no part and get no row.
    """
    offsets = ELEMENTS[element] if isinstance(element, str) else element
    near = [F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]
    place = lambda v, d: F.floor((F.col(v) - d) / tile)
    tiles = F.array_distinct(F.array(*[F.struct(place("r", a).alias("tr"), place("c", b).alias("tc")) for a, b in offsets]))
    dealt = px.select(*keys, "r", "c", F.col(value).alias("v"), F.explode(tiles).alias("t")).select(*keys, "t.tr", "t.tc", "r", "c", "v").repartition(*keys, "tr", "tc")
    sent = dealt.withColumn("s", F.explode(F.array(*near)))
    own = (F.col("s.dr") == 0) & (F.col("s.dc") == 0)
    to = sent.select(*keys, "tr", "tc", (F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), "v", own.alias("own"))
    inside = to.where((place("r", 0) == F.col("tr")) & (place("c", 0) == F.col("tc")))
    return inside.groupBy(*keys, "tr", "tc", "r", "c").agg(F.bool_or("own").alias("_own"), *aggs).where("_own").drop("_own", "tr", "tc")


def dilate(px: DataFrame, keys: list[str], value: str = "v", element: str | list[tuple[int, int]] = "square3") -> DataFrame:
    return focal(px, keys, value, element, [F.max("v").alias(value)])


def erode(px: DataFrame, keys: list[str], value: str = "v", element: str | list[tuple[int, int]] = "square3") -> DataFrame:
    """Missing neighbours count as 0: a pixel stays only with all its neighbours present and set."""
    full = len(ELEMENTS[element] if isinstance(element, str) else element)
    return focal(px, keys, value, element, [F.when(F.count("*") == full, F.min("v")).otherwise(0).alias(value)])


def opening(px: DataFrame, keys: list[str], value: str = "v", element: str = "square3", times: int = 1) -> DataFrame:
    """Erosion and dilation by the reflected element, so that elements without a middle move nothing."""
    for _ in range(times):
        px = dilate(erode(px, keys, value, element), keys, value, reflected(element))
    return px


def closing(px: DataFrame, keys: list[str], value: str = "v", element: str = "square3", times: int = 1) -> DataFrame:
    for _ in range(times):
        px = erode(dilate(px, keys, value, element), keys, value, reflected(element))
    return px


def clean_labels(px: DataFrame, keys: list[str], label: str, classes: list[int], background: int = 0) -> DataFrame:
    """keys, r, c, label with each class's mask opened by 2 x 2 and closed by 3 x 3, class after class: a class's pixels
    become background, then the cleaned mask its class. All classes go through one pass of each step."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), (F.col(label) == k).cast("int").alias("v")) for k in classes])).alias("m")
    masks = px.select(*keys, "r", "c", each).select(*keys, "m.cls", "r", "c", "m.v")
    clean = closing(opening(masks, [*keys, "cls"], "v", "square2"), [*keys, "cls"], "v", "square3")
    wide = clean.groupBy(*keys, "r", "c").agg(*[F.max(F.when(F.col("cls") == k, F.col("v"))).alias(f"_c{k}") for k in classes])
    out = F.col(label)
    for k in classes:
        out = F.when(F.col(f"_c{k}") == 1, k).when(F.col(label) == k, background).otherwise(out)
    return px.select(*keys, "r", "c", label).join(wide, [*keys, "r", "c"]).select(*keys, "r", "c", out.alias(label))


def dense(px: DataFrame, keys: list[str], value: str, height: int, width: int, fill) -> DataFrame:
    """Every pixel of a height x width grid for each key, missing ones filled; pixels beyond the grid go."""
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = px.select(*keys).distinct().withColumn("r", side(height)).withColumn("c", side(width))
    own = px.select(*keys, F.col("r").cast("long"), F.col("c").cast("long"), value)
    return grid.join(own, [*keys, "r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def with_group(px: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Each pixel with aggregates of its scene or chip: a small result joined back, so no scene is gathered in one task."""
    return px.join(px.groupBy(*keys).agg(*aggs), keys)


def align_clip(px: DataFrame, keys: list[str], value: str, factor: int, inside: Column) -> DataFrame:
    """keys, y, x and the mean of the value on a grid that is ``factor`` times coarser, over the valid pixels whose centre
    is ``inside``, a condition on r and c (see ``geometry.in_ring``); cells without such a pixel go."""
    kept = px.where(inside & ~F.isnan(value))
    return kept.groupBy(*keys, F.floor(F.col("r") / factor).alias("y"), F.floor(F.col("c") / factor).alias("x")).agg(F.avg(value).alias(value))


def cloud_mask(value: Column, scene_class: Column, keep: tuple[float, ...]) -> Column:
    """The value where the scene class is kept or unknown (NaN or null), else null; NaN values are null."""
    known = scene_class.isNotNull() & ~F.isnan(scene_class)
    return F.when(F.isnan(value) | (known & ~scene_class.isin(*keep)), None).otherwise(value)


def change_heat(px: DataFrame, keys: list[str], before: str = "v0", after: str = "v1", lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """keys, r, c, heat: mean over bands of the absolute difference by its deviation in the band, stretched to 0 .. 255
    between two percentiles of the chip."""
    d = px.where(~F.isnan(before) & ~F.isnan(after)).withColumn("d", F.col(after) - F.col(before))
    heat = with_group(d, [*keys, "band"], F.stddev_pop("d").alias("sd")).groupBy(*keys, "r", "c").agg(F.avg(F.abs("d") / (F.col("sd") + 1e-6)).alias("h"))
    q = quantiles(heat, keys, "h", [lo, hi]).drop("n")
    unit = F.least(F.greatest((F.col("h") - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0] + 1e-6), F.lit(0.0)), F.lit(1.0))
    return heat.join(q, keys).select(*keys, "r", "c", (unit * 255).alias("heat"))


def resize_nearest(px: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Square chips resized: each source pixel is listed under the target pixels (y, x) whose centre falls in it."""
    at = F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long"))
    under = lambda v: F.filter(at, lambda i: F.floor((i + 0.5) * source / target) == F.col(v))
    return px.withColumn("y", F.explode(under("r"))).withColumn("x", F.explode(under("c"))).drop("r", "c")


def resize_bilinear(px: DataFrame, keys: list[str], value: str, source: int, target: int) -> DataFrame:
    """keys, y, x, value: each source pixel is sent with its weight to the targets it reaches, and weights are summed; NaN is 0."""
    at = lambda i: F.least(F.greatest((i + 0.5) * source / target - 0.5, F.lit(0.0)), F.lit(source - 1.0))
    every = F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long"))
    reach = lambda v: F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), F.greatest(F.lit(0.0), 1 - F.abs(at(i) - F.col(v))).alias("w"))), lambda s: s["w"] > 0)
    sent = px.withColumn("y", F.explode(reach("r"))).withColumn("x", F.explode(reach("c")))
    return sent.groupBy(*keys, F.col("y.i").alias("y"), F.col("x.i").alias("x")).agg(F.sum(F.nanvl(value, F.lit(0.0)) * F.col("y.w") * F.col("x.w")).alias(value))


def mosaic(px: DataFrame, key: str, size: int, side: int = 2) -> DataFrame:
    """side x side chips in a row of the key as one (mosaic, r, c, ...): each gives its upper left size x size pixels."""
    k = F.col(key) % (side * side)
    kept = px.where((F.col("r") < size) & (F.col("c") < size))
    return kept.select(F.floor(F.col(key) / (side * side)).alias("mosaic"), (F.floor(k / side) * size + F.col("r")).alias("r"), (k % side * size + F.col("c")).alias("c"), *[c for c in px.columns if c not in (key, "r", "c")])


def windows(width: int, height: int, size: int, stride: int | None = None, align: bool = False) -> Column:
    """Array of (y, x) window offsets; with ``align`` a last window that ends at the edge is added where needed."""

    def axis(n: int) -> list[int]:
        at = list(range(0, n - size + 1, stride or size))
        return at + [n - size] if align and n >= size and at[-1] != n - size else at

    return F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in axis(height) for x in axis(width)])


def stretch(px: DataFrame, keys: list[str], value: str, lo: float, hi: float, least: int = 10) -> DataFrame:
    """Values stretched so that these percentiles become 0 and 1, clipped; groups with fewer than ``least`` finite values
    or without range stay as they are, and NaN stays NaN."""
    ends = quantiles(px, keys, value, [lo, hi])
    v, a, b = F.col(value), F.col("q")[0], F.col("q")[1]
    scaled = F.when(F.isnan(v), v).when((F.col("n") < least) | (b <= a), v).otherwise(F.least(F.greatest((v - a) / (b - a), F.lit(0.0)), F.lit(1.0)))
    return px.join(ends, keys).withColumn(value, scaled).drop("q", "n")


def rotate(name: str, r: Column, c: Column, n: int) -> tuple[Column, Column]:
    """Where a pixel of an n x n chip goes under a named augmentation."""
    last = n - 1
    return {"orig": (r, c), "rot90": (last - c, r), "rot180": (last - r, last - c), "rot270": (c, last - r), "fliph": (r, last - c), "flipv": (last - r, c)}[name]


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


ACTIVATIONS = {
    "sigmoid": lambda a: F.transform(a, lambda x: sigmoid(x)),
    "softmax": softmax,
    "logsoftmax": lambda a: F.transform(softmax(a), lambda x: F.log(x)),
    "tanh": lambda a: F.transform(a, lambda x: F.tanh(x)),
    "clamp": lambda a: F.transform(a, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))),
    "identity": lambda a: a,
}


def equalize(px: DataFrame, keys: list[str], level: str, levels: int = 256) -> DataFrame:
    """Histogram equalisation per group: at most ``levels`` counts a group are accumulated and looked up."""
    hist = px.groupBy(*keys, level).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy(level)
    whole = Window.partitionBy(*keys)
    cdf = hist.withColumn("cum", F.sum("n").over(run)).withColumn("tot", F.sum("n").over(whole)).withColumn("low", F.min("cum").over(whole))
    flat = F.when(F.col("tot") == F.col("low"), F.col(level)).otherwise(F.round((F.col("cum") - F.col("low")) / (F.col("tot") - F.col("low")) * (levels - 1)))
    return px.join(cdf.select(*keys, level, flat.cast("int").alias("equalized")), [*keys, level])
