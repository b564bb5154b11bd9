"""Queries on pixels, tiles, chips and regions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terradelta.checkpoints import cut, shared_folder
from terradelta.functions import geometry as G
from terradelta.operators import component_tree as CT
from terradelta.operators import components as CC
from terradelta.operators import focal as FC
from terradelta.operators import metrics as M
from terradelta.operators import outlines as OL
from terradelta.operators import raster as R
from terradelta.operators import scenes as SC
from terradelta.operators.quantiles import quantiles
from terradelta.plans.registry import query
from terradelta.sinks import writers as W
from terradelta.sources import readers as RD

SCENE = ["scene_id"]
KEY = ["scene_id", "r", "c"]
NAN = "'NaN'::DOUBLE"


def n_if(cond):
    return M.n_if(cond)


# --- masks -----------------------------------------------------------------------------------------------------------
query("mask_remap", "cls_px", "SELECT scene_id, r, c, CASE WHEN label = 255 THEN 255 WHEN label = 0 THEN 0 ELSE 1 END AS kept, CASE WHEN label = 0 THEN 0 ELSE 1 END AS filled FROM cls_px")(
    lambda px: px.select(*KEY, F.when(F.col("label") == 255, 255).when(F.col("label") == 0, 0).otherwise(1).alias("kept"), F.when(F.col("label") == 0, 0).otherwise(1).alias("filled"))
)
_DIRTY = ", q AS (SELECT scene_id, r, c, CASE WHEN scene_id % 3 = 0 OR label = 255 THEN label ELSE label % 2 END AS label FROM cls_px)"


def remap_dirty(px):
    """Classes become 1 in scenes that hold others than 0, 1 and 255; the other scenes stay as they are."""
    dirty = R.with_group(px, SCENE, F.bool_or(~F.col("label").isin(0, 1, 255)).alias("dirty"))
    return dirty.select(*KEY, F.when(F.col("dirty") & ~F.col("label").isin(0, 255), 1).otherwise(F.col("label")).alias("label"))


query("mask_remap_dirty_only", "cls_px", _DIRTY + ", d AS (SELECT scene_id, bool_or(label NOT IN (0, 1, 255)) AS dirty FROM q GROUP BY scene_id) SELECT scene_id, r, c, CASE WHEN dirty AND label NOT IN (0, 255) THEN 1 ELSE label END AS label FROM q JOIN d USING (scene_id)")(
    lambda px: remap_dirty(px.withColumn("label", F.expr("CASE WHEN scene_id % 3 = 0 OR label = 255 THEN label ELSE label % 2 END")))
)
query("first_channel", "chips", "SELECT chip_id, array_to_string(list_transform(t0[1:16], lambda x: CASE WHEN isnan(x) THEN 'n' ELSE round(x * 100)::INT::VARCHAR END), ',') AS v FROM chips")(
    lambda c: c.select("chip_id", F.array_join(F.transform(F.slice("t0", 1, 16), lambda x: F.when(F.isnan(x), "n").otherwise(F.round(x * 100).cast("int").cast("string"))), ",").alias("v"))
)
_TILE = ", s AS (SELECT scene_id, r // 16 AS ty, c // 16 AS tx, count(*) FILTER (gt = 1) AS pos, count(*) FILTER (gt = 255) AS ign, count(*) FILTER (gt <> 255) AS valid FROM px GROUP BY ALL)"


def _tiles(px):
    return px.groupBy("scene_id", F.expr("r div 16").alias("ty"), F.expr("c div 16").alias("tx")).agg(n_if(F.col("gt") == 1).alias("pos"), n_if(F.col("gt") == 255).alias("ign"), n_if(F.col("gt") != 255).alias("valid"))


query("chip_filter_change", "px", _TILE + "SELECT * FROM s WHERE pos >= 20 AND ign <= 0.5 * 256 AND valid > 0 AND pos <= 0.9 * 256")(lambda px: _tiles(px).where("pos >= 20 AND ign <= 0.5 * 256 AND valid > 0 AND pos <= 0.9 * 256"))
query("scene_filter_nochange", "px", "SELECT scene_id FROM px GROUP BY scene_id HAVING count(*) FILTER (gt = 1) > 0 AND max(r) = 63 AND max(c) = 63")(lambda px: px.groupBy("scene_id").agg(n_if(F.col("gt") == 1).alias("p"), F.max("r").alias("h"), F.max("c").alias("w")).where("p > 0 AND h = 63 AND w = 63").select("scene_id"))
query("chip_filter_valid", "chip_px", "SELECT chip_id FROM chip_px GROUP BY chip_id HAVING avg(CASE WHEN isnan(v0) THEN 0 ELSE 1 END) >= 0.3")(lambda px: px.groupBy("chip_id").agg(F.avg(F.when(F.isnan("v0"), 0).otherwise(1)).alias("q")).where("q >= 0.3").select("chip_id"))
query("threshold_mask", "px", "SELECT scene_id, r, c, (prob >= 0.5)::INT AS ge, (prob > 0.5)::INT AS gt FROM px")(lambda px: px.select(*KEY, (F.col("prob") >= 0.5).cast("int").alias("ge"), (F.col("prob") > 0.5).cast("int").alias("gt")))
query("threshold_fallback", "px", ", n AS (SELECT *, count(*) FILTER (prob >= 1.05 - scene_id % 2 * 0.5) OVER (PARTITION BY scene_id) AS n FROM px) SELECT scene_id, r, c, CASE WHEN n < 10 THEN (prob >= 0.15)::INT ELSE (prob >= 1.05 - scene_id % 2 * 0.5)::INT END AS mask FROM n")(
    lambda px: threshold_fallback(px, F.col("prob") >= 1.05 - F.col("scene_id") % 2 * 0.5, F.col("prob") >= 0.15, 10)
)


def threshold_fallback(px, first, second, least):
    """A scene's mask by the first condition, or by the second where fewer than ``least`` pixels meet the first."""
    counted = R.with_group(px.withColumn("first", first), SCENE, n_if(F.col("first")).alias("n"))
    return counted.select(*KEY, F.when(F.col("n") < least, second).otherwise(F.col("first")).cast("int").alias("mask"))

# --- tiles -----------------------------------------------------------------------------------------------------------
query("tile_windows", "px", ", s AS (SELECT DISTINCT scene_id FROM px), a AS (SELECT unnest([0, 20, 40]) AS o) SELECT scene_id, y.o AS y, x.o AS x FROM s, a y, a x")(lambda px: px.select("scene_id").distinct().select("scene_id", F.explode(R.windows(64, 64, 20)).alias("w")).select("scene_id", "w.y", "w.x"))
query("tile_windows_stride", "px", ", s AS (SELECT DISTINCT scene_id FROM px), a AS (SELECT unnest([0, 15, 30, 44]) AS o) SELECT scene_id, y.o AS y, x.o AS x FROM s, a y, a x")(lambda px: px.select("scene_id").distinct().select("scene_id", F.explode(R.windows(64, 64, 20, 15, align=True)).alias("w")).select("scene_id", "w.y", "w.x"))
query("tile_bounds", "px", ", s AS (SELECT DISTINCT scene_id FROM px), a AS (SELECT unnest([0, 20, 40]) AS o) SELECT scene_id, 500.0::DOUBLE + x.o * 10 AS xmin, 500.0::DOUBLE + (x.o + 20) * 10 AS xmax, 9000.0::DOUBLE - (y.o + 20) * 10 AS ymin, 9000.0::DOUBLE - y.o * 10 AS ymax FROM s, a y, a x")(
    lambda px: px.select("scene_id").distinct().select("scene_id", F.explode(R.windows(64, 64, 20)).alias("w")).select("scene_id", (500.0 + F.col("w.x") * 10).alias("xmin"), (500.0 + (F.col("w.x") + 20) * 10).alias("xmax"), (9000.0 - (F.col("w.y") + 20) * 10).alias("ymin"), (9000.0 - F.col("w.y") * 10).alias("ymax"))
)
query("tile_pad", "chip_px", ", g AS (SELECT DISTINCT chip_id, y, x FROM chip_px, (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS x) WHERE band = 0) SELECT g.chip_id, y, x, coalesce(round(nullif(v0, 'NaN'::DOUBLE), 6), 0) AS v FROM g LEFT JOIN chip_px p ON p.chip_id = g.chip_id AND p.r = y AND p.c = x AND band = 0")(
    lambda px: R.dense(px.where("band = 0").withColumn("v", F.when(~F.isnan("v0"), F.col("v0"))), ["chip_id"], "v", 6, 6, 0.0).select("chip_id", F.col("r").alias("y"), F.col("c").alias("x"), F.round("v", 6).alias("v"))
)
query("tile_stitch", "px", ", t AS (SELECT scene_id, r // 16 AS ty, c // 16 AS tx, r % 16 AS y, c % 16 AS x, prob FROM px UNION ALL SELECT scene_id, r // 16 AS ty, c // 16 AS tx, r % 16, c % 16, prob / 2 FROM px WHERE r % 16 = 0) SELECT scene_id, ty * 16 + y AS r, tx * 16 + x AS c, max(prob) AS prob FROM t GROUP BY ALL")(
    lambda px: _stitch(px)
)


def _stitch(px):
    cut = px.select("scene_id", F.expr("r div 16").alias("ty"), F.expr("c div 16").alias("tx"), (F.col("r") % 16).alias("y"), (F.col("c") % 16).alias("x"), "prob")
    overlap = cut.where("y = 0").withColumn("prob", F.col("prob") / 2)
    return cut.unionByName(overlap).groupBy("scene_id", (F.col("ty") * 16 + F.col("y")).alias("r"), (F.col("tx") * 16 + F.col("x")).alias("c")).agg(F.max("prob").alias("prob"))


@query("raster_window", "px", ", g AS (SELECT scene_id, y AS r, x AS c FROM (SELECT DISTINCT scene_id FROM px), (SELECT unnest(range(10, 20)) AS y), (SELECT unnest(range(30, 45)) AS x)) SELECT g.*, coalesce(prob, 0) AS prob FROM g LEFT JOIN px USING (scene_id, r, c)")
def raster_window(px, y=10, x=30, height=10, width=15):
    """A window of every scene from a store of tiles, missing pixels as 0."""
    spark, path = px.sparkSession, f"{shared_folder(px.sparkSession)}/raster-{uuid.uuid4().hex}"
    s = F.col("scene_id")
    W.write_raster(px, path, "prob", affine=W.north_up(s % 10 * 10000.0, F.expr("scene_id div 10 % 10") * 10000.0 + 6400, 100.0), crs="EPSG:32643", tile=8)
    own = RD.read_raster(spark, path, y, x, height, width, tile=8).select(*KEY, "v")
    side = lambda a, n: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(a + n - 1).cast("long")))
    grid = px.select("scene_id").distinct().withColumn("r", side(y, height)).withColumn("c", side(x, width))
    return grid.join(own, KEY, "left").select(*KEY, F.coalesce("v", F.lit(0.0)).alias("prob"))


# --- pixel arithmetic ------------------------------------------------------------------------------------------------
_SCL = "(chip_id + r * 3 + c * 5) % 13"
KEEP = (4.0, 5.0, 6.0, 7.0, 11.0)
query("cloud_mask", "chip_px", f"SELECT chip_id, band, r, c, CASE WHEN {_SCL} IN (4, 5, 6, 7, 11, 12) AND NOT isnan(v0) THEN round(v0, 6) END AS v FROM chip_px")(
    lambda px: px.withColumn("scl", F.when(F.expr(_SCL) == 12, F.lit(float("nan"))).otherwise(F.expr(_SCL).cast("double"))).select("chip_id", "band", "r", "c", F.round(R.cloud_mask(F.col("v0"), F.col("scl"), KEEP), 6).alias("v"))
)
query("cloud_mask_crop", "chip_px", f"SELECT chip_id, band, r, c, CASE WHEN isnan(v0) OR (r < 3 AND {_SCL} NOT IN (4, 5, 6, 7, 11)) THEN NULL ELSE round(v0, 6) END AS v FROM chip_px")(
    lambda px: px.join(px.where("r < 3").select("chip_id", "r", "c", F.expr(_SCL).cast("double").alias("scl")).distinct(), ["chip_id", "r", "c"], "left").select("chip_id", "band", "r", "c", F.round(R.cloud_mask(F.col("v0"), F.col("scl"), KEEP), 6).alias("v"))
)
query("scl_quality", "chip_px", f", s AS (SELECT chip_id, {_SCL} AS scl FROM chip_px WHERE band = 0) SELECT chip_id, round(avg((scl IN (4, 5, 6, 7, 11))::INT), 6) AS kept, count(DISTINCT scl) FILTER (scl > 11) AS unexpected FROM s GROUP BY chip_id")(
    lambda px: px.where("band = 0").withColumn("scl", F.expr(_SCL)).groupBy("chip_id").agg(F.round(F.avg(F.col("scl").isin(4, 5, 6, 7, 11).cast("int")), 6).alias("kept"), F.count_distinct(F.when(F.col("scl") > 11, F.col("scl"))).alias("unexpected"))
)
#: An AOI in pixel coordinates (x = c + 0.5, y = r + 0.5 at a pixel's centre): a triangle.
_AOI = ((0.0, 0.0), (4.3, 0.0), (0.0, 4.3), (0.0, 0.0))
query("grid_align_clip", "chip_px", "SELECT chip_id, r // 2 AS y, c // 2 AS x, round(avg(v0), 6) AS v FROM chip_px WHERE band = 0 AND r + c + 1 < 4.3 AND NOT isnan(v0) GROUP BY ALL")(
    lambda px: R.align_clip(px.where("band = 0"), ["chip_id"], "v0", 2, G.in_ring(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in _AOI]), F.col("c") + 0.5, F.col("r") + 0.5)).select("chip_id", "y", "x", F.round("v0", 6).alias("v"))
)
query("band_stack", "chip_px", "SELECT chip_id, r, c, round(nullif(max(v0) FILTER (band = 0), 'NaN'::DOUBLE), 6) AS b0, round(nullif(max(v0) FILTER (band = 3), 'NaN'::DOUBLE), 6) AS b3 FROM chip_px GROUP BY ALL")(
    lambda px: px.groupBy("chip_id", "r", "c").pivot("band", [0, 1, 2, 3]).agg(F.max("v0")).select("chip_id", "r", "c", *[F.when(~F.isnan(str(b)), F.round(str(b), 6)).alias(f"b{b}") for b in (0, 3)])
)
query("scale_unit", "px", ", v AS (SELECT scene_id, r, c, prob * CASE WHEN scene_id % 2 = 0 THEN 255 ELSE 1 END AS v FROM px) SELECT scene_id, r, c, round(CASE WHEN max(v) OVER (PARTITION BY scene_id) > 2 THEN v / 255 ELSE v END, 6) AS v FROM v")(
    lambda px: scale_unit(px.withColumn("v", F.col("prob") * F.when(F.col("scene_id") % 2 == 0, 255).otherwise(1)))
)


def scale_unit(px):
    """Scenes with values above 2 are taken as bytes and divided by 255."""
    return R.with_group(px, SCENE, F.max("v").alias("top")).select(*KEY, F.round(F.when(F.col("top") > 2, F.col("v") / 255).otherwise(F.col("v")), 6).alias("v"))


#: Channel means and deviations (fixed values).
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
query("imagenet_norm", "chip_px", f"SELECT chip_id, band, r, c, round((v0 - {list(MEAN)}[band + 1]) / {list(STD)}[band + 1], 5) AS v FROM chip_px WHERE band < 3 AND NOT isnan(v0)")(
    lambda px: px.where("band < 3 AND NOT isnan(v0)").select("chip_id", "band", "r", "c", F.round((F.col("v0") - F.element_at(F.array(*map(F.lit, MEAN)), F.col("band").cast("int") + 1)) / F.element_at(F.array(*map(F.lit, STD)), F.col("band").cast("int") + 1), 5).alias("v"))
)
query("valid_mask", "chip_px", "SELECT chip_id, r, c, bool_and(NOT isnan(v0) AND NOT isnan(v1)) AS valid FROM chip_px GROUP BY ALL")(lambda px: px.groupBy("chip_id", "r", "c").agg(F.bool_and(~F.isnan("v0") & ~F.isnan("v1")).alias("valid")))
query("nan_zero", "chip_px", "SELECT chip_id, band, r, c, CASE WHEN isnan(v0) OR isinf(v0) THEN 0 ELSE round(v0, 6) END AS v FROM chip_px")(lambda px: px.select("chip_id", "band", "r", "c", F.when(F.isnan("v0") | (F.abs("v0") == float("inf")), 0.0).otherwise(F.round("v0", 6)).alias("v")))
_HEAT = ", d AS (SELECT *, v1 - v0 AS d FROM chip_px WHERE NOT isnan(v0) AND NOT isnan(v1)), s AS (SELECT *, stddev_pop(d) OVER (PARTITION BY chip_id, band) AS sd FROM d), h AS (SELECT chip_id, r, c, avg(abs(d) / (sd + 1e-6)) AS h FROM s GROUP BY ALL), q AS (SELECT chip_id, quantile_cont(h, 0.02) AS lo, quantile_cont(h, 0.98) AS hi FROM h GROUP BY chip_id)"


query("change_heat", "chip_px", _HEAT + "SELECT chip_id, r, c, round(least(greatest((h - lo) / (hi - lo + 1e-6), 0), 1) * 255, 4) AS heat FROM h JOIN q USING (chip_id)")(lambda px: R.change_heat(px, ["chip_id"]).withColumn("heat", F.round("heat", 4)))


def band_difference():
    """The default scorer: the mean absolute difference over bands, 0 on masked pixels."""
    import numpy as np

    return lambda before, after: np.nan_to_num(np.abs(after - before).mean(0))


def score_chips(px, make_scorer=band_difference, shape=(4, 4, 4)):
    """(chip_id, k, prob) of each pixel k of a chip. make_scorer: makes, once per task, a function of both dates' arrays
    [bands, rows, columns] that gives a score for each pixel, such as a network that it loads."""
    import numpy as np
    import pandas as pd

    def run(parts):
        scorer = make_scorer()
        for p in parts:
            scored = [np.asarray(scorer(np.array(a, float).reshape(shape), np.array(b, float).reshape(shape)), float).ravel().tolist() for a, b in zip(p["t0"], p["t1"], strict=True)]
            yield pd.DataFrame({"chip_id": p["chip_id"], "prob": scored})

    _, rows, columns = shape
    cells = F.sort_array(F.collect_list(F.struct((F.col("band") * (rows * columns) + F.col("r") * columns + F.col("c")).alias("i"), "v0", "v1")))
    arrays = px.groupBy("chip_id").agg(cells.alias("p")).select("chip_id", F.col("p.v0").alias("t0"), F.col("p.v1").alias("t1"))
    scored = arrays.mapInPandas(run, "chip_id long, prob array<double>")
    return scored.select("chip_id", F.posexplode("prob").alias("k", "prob")).select("chip_id", F.col("k").cast("long").alias("k"), "prob")


query("score_chips", "chip_px", "SELECT chip_id, r * 4 + c AS k, round(coalesce(nullif(avg(abs(v1 - v0)), 'NaN'::DOUBLE), 0), 6) AS prob FROM chip_px GROUP BY ALL")(lambda px: score_chips(px).withColumn("prob", F.round("prob", 6)))


_DIFF = ", d AS (SELECT chip_id, r, c, band, abs(v1 - v0) AS d FROM chip_px WHERE NOT isnan(v0) AND NOT isnan(v1))"


@query("pseudo_target", "chip_px", _DIFF + "SELECT chip_id, r, c, round(avg(d), 6) AS mean, round(max(d), 6) AS top, round(sum(d * [0.2, 0.3, 0.3, 0.2][band + 1]), 6) AS weighted FROM d GROUP BY ALL")
def pseudo_target(px):
    d = px.where("NOT isnan(v0) AND NOT isnan(v1)").withColumn("d", F.abs(F.col("v1") - F.col("v0")))
    w = F.element_at(F.array(*map(F.lit, (0.2, 0.3, 0.3, 0.2))), F.col("band").cast("int") + 1)
    return d.groupBy("chip_id", "r", "c").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("top"), F.round(F.sum(F.col("d") * w), 6).alias("weighted"))


def _stretch_sql(lo: float, hi: float) -> str:
    return f", q AS (SELECT chip_id, band, quantile_cont(v0, {lo}) FILTER (NOT isnan(v0)) AS a, quantile_cont(v0, {hi}) FILTER (NOT isnan(v0)) AS b, count(*) FILTER (NOT isnan(v0)) AS n FROM chip_px GROUP BY ALL), s AS (SELECT chip_id, band, r, c, CASE WHEN n < 10 OR b <= a THEN v0 ELSE least(greatest((v0 - a) / (b - a), 0), 1) END AS v FROM chip_px JOIN q USING (chip_id, band) WHERE NOT isnan(v0))"


query("percentile_stretch", "chip_px", _stretch_sql(0.02, 0.98) + "SELECT chip_id, band, r, c, round(v, 6) AS v FROM s")(lambda px: R.stretch(px, ["chip_id", "band"], "v0", 0.02, 0.98).where("NOT isnan(v0)").select("chip_id", "band", "r", "c", F.round("v0", 6).alias("v")))
query("rgb_preview", "chip_px", _stretch_sql(0.02, 0.98) + "SELECT chip_id, r, c, coalesce(max(floor(v * 255)) FILTER (band = 2), 0)::INT AS red, coalesce(max(floor(v * 255)) FILTER (band = 1), 0)::INT AS green, coalesce(max(floor(v * 255)) FILTER (band = 0), 0)::INT AS blue FROM s WHERE band < 3 GROUP BY ALL")(
    lambda px: R.stretch(px.where("band < 3"), ["chip_id", "band"], "v0", 0.02, 0.98).where("NOT isnan(v0)").groupBy("chip_id", "r", "c").agg(*[F.coalesce(F.max(F.when(F.col("band") == b, F.floor(F.col("v0") * 255).cast("int"))), F.lit(0)).alias(n) for b, n in ((2, "red"), (1, "green"), (0, "blue"))])
)
query("p99_normalize", "chip_px", ", z AS (SELECT chip_id, band, r, c, CASE WHEN isnan(v0) THEN 0 ELSE v0 END AS v FROM chip_px), q AS (SELECT chip_id, band, quantile_cont(v, 0.99) AS q FROM z GROUP BY ALL) SELECT chip_id, band, r, c, round(least(greatest(v / CASE WHEN q <= 0 THEN 1 ELSE q END, 0), 1), 6) AS v FROM z JOIN q USING (chip_id, band)")(
    lambda px: _p99(px)
)


def _p99(px):
    z = px.select("chip_id", "band", "r", "c", F.nanvl("v0", F.lit(0.0)).alias("v"))
    q = quantiles(z, ["chip_id", "band"], "v", [0.99]).select("chip_id", "band", F.col("q")[0].alias("q"))
    return z.join(q, ["chip_id", "band"]).select("chip_id", "band", "r", "c", F.round(F.least(F.greatest(F.col("v") / F.when(F.col("q") <= 0, 1.0).otherwise(F.col("q")), F.lit(0.0)), F.lit(1.0)), 6).alias("v"))


_LOGIT = ", a AS (SELECT scene_id, r, c, [prob, 1 - prob, pred_cls / 4.0, 0.5]::DOUBLE[] AS s FROM px), e AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM a), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"


def _scores(px):
    return px.select(*KEY, F.array(F.col("prob"), 1 - F.col("prob"), F.col("pred_cls") / 4.0, F.lit(0.5)).alias("s"))


query("class_probs", "px", _LOGIT + "SELECT scene_id, r, c, round(1 - p[1], 6) AS p_change, list_position(s, list_max(s)) - 1 AS cls FROM p")(lambda px: _scores(px).select(*KEY, F.round(1 - R.softmax(F.col("s"))[0], 6).alias("p_change"), R.argmax(F.col("s")).cast("int").alias("cls")))
query("activation", "px", _LOGIT + "SELECT scene_id, r, c, round(1 / (1 + exp(-s[1])), 6) AS sigmoid, round(p[1], 6) AS softmax, round(ln(p[1]), 6) AS logsoftmax, round(tanh(s[1]), 6) AS tanh, round(least(greatest(s[1], 0), 1), 6) AS clamp, round(s[1], 6) AS identity FROM p")(lambda px: _scores(px).select(*KEY, *[F.round(f(F.col("s"))[0], 6).alias(n) for n, f in R.ACTIVATIONS.items()]))
query("math_clip", "px", "SELECT scene_id, r, c, round(least(greatest(prob * 2 - 0.5, 0), 1), 6) AS clip, round(CASE WHEN gt = 0 THEN 0 ELSE prob / gt END, 6) AS safe, round(sqrt(prob), 6) AS root, round(ln(prob + 1e-6), 6) AS log, round(1 / (1 + exp(-prob)), 6) AS sigmoid FROM px")(
    lambda px: px.select(*KEY, F.round(F.least(F.greatest(F.col("prob") * 2 - 0.5, F.lit(0.0)), F.lit(1.0)), 6).alias("clip"), F.round(F.coalesce(F.try_divide(F.col("prob"), F.col("gt")), F.lit(0.0)), 6).alias("safe"), F.round(F.sqrt("prob"), 6).alias("root"), F.round(F.log(F.col("prob") + 1e-6), 6).alias("log"), F.round(R.sigmoid(F.col("prob")), 6).alias("sigmoid"))
)
query("array_ops", "chips", "SELECT chip_id, len(t0 || t1) AS both, round(CASE WHEN isnan(t0[17]) THEN 0 ELSE t0[17] END, 6) AS band1, round(CASE WHEN isnan(t0[5]) THEN 0 ELSE t0[5] END, 6) AS hwc4 FROM chips")(
    lambda c: c.select("chip_id", F.size(F.concat("t0", "t1")).alias("both"), F.nanvl(F.round(F.slice("t0", 17, 16)[0], 6), F.lit(0.0)).alias("band1"), F.nanvl(F.round(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(F.col("t0"), i % 4 * 16 + (i / 4).cast("int")))[16], 6), F.lit(0.0)).alias("hwc4"))
)
query("exchange_time", "chips", "SELECT chip_id, round(CASE WHEN isnan(x) THEN 0 ELSE x END, 6) AS first FROM (SELECT chip_id, CASE WHEN chip_id % 2 = 0 THEN t1[1] ELSE t0[1] END AS x FROM chips)")(
    lambda c: c.select("chip_id", F.when(F.col("chip_id") % 2 == 0, F.col("t1")).otherwise(F.col("t0")).alias("t0")).select("chip_id", F.nanvl(F.round(F.col("t0")[0], 6), F.lit(0.0)).alias("first"))
)
_AUG = {"orig": ("r", "c"), "rot90": ("3 - c", "r"), "rot180": ("3 - r", "3 - c"), "rot270": ("c", "3 - r"), "fliph": ("r", "3 - c"), "flipv": ("3 - r", "c")}
query("augment_labels", "chip_px", " UNION ALL ".join(f"SELECT chip_id || '_{k}' AS chip, {a} AS r, {b} AS c, (v0 > 0)::INT AS label FROM chip_px WHERE band = 0 AND NOT isnan(v0)" for k, (a, b) in _AUG.items()))(lambda px: _augment(px))


def _augment(px):
    moves = F.array(*[F.struct(F.lit(k).alias("k"), *[x.cast("long").alias(n) for x, n in zip(R.rotate(k, F.col("r"), F.col("c"), 4), ("r", "c"), strict=True)]) for k in _AUG])
    one = px.where("band = 0 AND NOT isnan(v0)").select("chip_id", (F.col("v0") > 0).cast("int").alias("label"), F.explode(moves).alias("m"))
    return one.select(F.concat(F.col("chip_id").cast("string"), F.lit("_"), "m.k").alias("chip"), "m.r", "m.c", "label")


query("mosaic_2x2", "chip_px", "SELECT chip_id // 4 AS mosaic, (chip_id % 4 // 2) * 2 + r AS r, (chip_id % 2) * 2 + c AS c, CASE WHEN isnan(v0) THEN 0 ELSE round(v0, 6) END AS v FROM chip_px WHERE band = 0 AND r < 2 AND c < 2")(
    lambda px: R.mosaic(px.where("band = 0").select("chip_id", "r", "c", F.nanvl(F.round("v0", 6), F.lit(0.0)).alias("v")), "chip_id", 2)
)
query("resize_nearest", "chip_px", "SELECT chip_id, y, x, CASE WHEN isnan(v0) THEN 0 ELSE round(v0, 6) END AS v FROM chip_px, (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS x) WHERE band = 0 AND r = floor((y + 0.5) * 4 / 6) AND c = floor((x + 0.5) * 4 / 6)")(
    lambda px: R.resize_nearest(px.where("band = 0"), ["chip_id"], 4, 6).select("chip_id", "y", "x", F.nanvl(F.round("v0", 6), F.lit(0.0)).alias("v"))
)
_BIL = "greatest(0, 1 - abs(least(greatest((y + 0.5) * 4 / 6 - 0.5, 0), 3) - r)) * greatest(0, 1 - abs(least(greatest((x + 0.5) * 4 / 6 - 0.5, 0), 3) - c))"
query("resize_bilinear", "chip_px", f"SELECT chip_id, y, x, round(sum(v0 * {_BIL}), 6) AS v FROM (SELECT chip_id, r, c, CASE WHEN isnan(v0) THEN 0 ELSE v0 END AS v0 FROM chip_px WHERE band = 0), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS x) GROUP BY ALL")(
    lambda px: R.resize_bilinear(px.where("band = 0"), ["chip_id"], "v0", 4, 6).select("chip_id", "y", "x", F.round("v0", 6).alias("v"))
)
query("hist_equalize", "px", ", l AS (SELECT scene_id, r, c, (prob * 25)::INT AS level FROM px), h AS (SELECT scene_id, level, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY scene_id ORDER BY level) AS cum, sum(n) OVER (PARTITION BY scene_id) AS tot FROM h), m AS (SELECT *, min(cum) OVER (PARTITION BY scene_id) AS low FROM k) SELECT scene_id, r, c, (CASE WHEN tot = low THEN level ELSE round((cum - low)::DOUBLE / (tot - low) * 255) END)::INT AS equalized FROM l JOIN m USING (scene_id, level)")(
    lambda px: R.equalize(px.select(*KEY, F.round(F.col("prob") * 25).cast("int").alias("level")), SCENE, "level").select(*KEY, "equalized")
)

# --- neighbourhoods --------------------------------------------------------------------------------------------------
_NEAR = ", m AS (SELECT scene_id, r, c, (prob >= 0.5)::INT AS v, prob FROM px), n AS (SELECT a.scene_id, a.r, a.c, b.v, b.prob FROM m a JOIN m b ON a.scene_id = b.scene_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1)"


def _mask(px):
    return px.select(*KEY, (F.col("prob") >= 0.5).cast("int").alias("v"))


query("box_blur", "px", _NEAR + "SELECT scene_id, r, c, round(avg(prob), 6) AS v FROM n GROUP BY ALL")(lambda px: FC.square(px, SCENE, "prob", 1, "mean", "v").withColumn("v", F.round("v", 6)))
query("median_filter", "px", _NEAR + "SELECT scene_id, r, c, round(quantile_cont(prob, 0.5), 6) AS v FROM n GROUP BY ALL")(lambda px: FC.square(px, SCENE, "prob", 1, "median", "v").withColumn("v", F.round("v", 6)))
query("dilate", "px", _NEAR + "SELECT scene_id, r, c, max(v) AS v FROM n GROUP BY ALL")(lambda px: FC.square(_mask(px), SCENE, "v", 1, "max").withColumn("v", F.col("v").cast("int")))
query("erode", "px", _NEAR + "SELECT scene_id, r, c, CASE WHEN count(*) = 9 THEN min(v) ELSE 0 END AS v FROM n GROUP BY ALL")(lambda px: FC.square(_mask(px), SCENE, "v", 1, "whole_min").withColumn("v", F.col("v").cast("int")))
_CROSS = "b.scene_id = a.scene_id AND abs(b.r - a.r) + abs(b.c - a.c) <= 1"
_OPEN = f", m AS MATERIALIZED (SELECT scene_id, r, c, (prob >= 0.3)::INT AS v FROM px), e AS MATERIALIZED (SELECT a.scene_id, a.r, a.c, CASE WHEN count(*) = 5 THEN min(b.v) ELSE 0 END AS v FROM m a JOIN m b ON {_CROSS} GROUP BY ALL), d AS MATERIALIZED (SELECT a.scene_id, a.r, a.c, max(b.v) AS v FROM e a JOIN e b ON {_CROSS} GROUP BY ALL)"
#: Offsets of the ellipse of 7, for SQL: rows of a disc of radius 3.
_DISC = "(SELECT a, b FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE abs(b) <= round(sqrt(9 - a * a)))"
_FULL = f""", u AS MATERIALIZED (SELECT s.scene_id, y AS r, x AS c, coalesce((prob >= 0.3)::INT, 0) AS v FROM (SELECT DISTINCT scene_id FROM px) s, (SELECT unnest(range(64)) AS y), (SELECT unnest(range(64)) AS x) LEFT JOIN px ON px.scene_id = s.scene_id AND px.r = y AND px.c = x),
u1 AS MATERIALIZED (SELECT m.scene_id, m.r, m.c, max(n.v) AS v FROM (SELECT u.*, a, b FROM u, {_DISC}) m JOIN u n ON n.scene_id = m.scene_id AND n.r = m.r + a AND n.c = m.c + b GROUP BY ALL),
u2 AS (SELECT m.scene_id, m.r, m.c, CASE WHEN count(*) = 33 THEN min(n.v) ELSE 0 END AS v FROM (SELECT u1.*, a, b FROM u1, {_DISC}) m JOIN u1 n ON n.scene_id = m.scene_id AND n.r = m.r + a AND n.c = m.c + b GROUP BY ALL)"""
query("morph_open_close", "px", _OPEN + _FULL + f", d2 AS MATERIALIZED (SELECT a.scene_id, a.r, a.c, max(b.v) AS v FROM d a JOIN d b ON {_CROSS} GROUP BY ALL), o AS (SELECT a.scene_id, a.r, a.c, CASE WHEN count(*) = 5 THEN min(b.v) ELSE 0 END AS v FROM d2 a JOIN d2 b ON {_CROSS} GROUP BY ALL) SELECT o.*, u2.v AS closed7 FROM o JOIN u2 USING (scene_id, r, c)")(
    lambda px: morph_open_close(px)
)


def morph_open_close(px):
    """Opening and closing by the ellipse of 3, twice each (the second changes nothing more), and closing by the ellipse of
    7 on the whole grid, where missing pixels are 0."""
    mask = px.select(*KEY, (F.col("prob") >= 0.3).cast("int").alias("v"))
    small = R.closing(R.opening(mask, SCENE, "v", "ellipse3"), SCENE, "v", "ellipse3")
    wide = R.closing(R.dense(mask, SCENE, "v", 64, 64, 0), SCENE, "v", "ellipse7")
    return small.join(wide.withColumnRenamed("v", "closed7"), KEY)


_NEXT = "(SELECT unnest(range({a}, {b})) AS dr) i, (SELECT unnest(range({a}, {b})) AS dc) j"


def _near_sql(table: str, value: str, a: int, b: int) -> str:
    return f"SELECT m.scene_id, m.k, m.r, m.c, {value} AS v FROM (SELECT {table}.*, dr, dc FROM {table}, {_NEXT.format(a=a, b=b)}) m JOIN {table} n ON n.scene_id = m.scene_id AND n.k = m.k AND n.r = m.r + dr AND n.c = m.c + dc GROUP BY ALL"


_CLEAN = f""", k0 AS MATERIALIZED (SELECT scene_id, k, r, c, (pred_cls = k)::INT AS v FROM px, (SELECT unnest([1, 2, 3]) AS k)),
k1 AS MATERIALIZED ({_near_sql("k0", "CASE WHEN count(*) = 4 THEN min(n.v) ELSE 0 END", 0, 2)}), k2 AS MATERIALIZED ({_near_sql("k1", "max(n.v)", -1, 1)}),
k3 AS MATERIALIZED ({_near_sql("k2", "max(n.v)", -1, 2)}), k4 AS ({_near_sql("k3", "CASE WHEN count(*) = 9 THEN min(n.v) ELSE 0 END", -1, 2)}),
kw AS (SELECT scene_id, r, c, max(v) FILTER (k = 1) AS c1, max(v) FILTER (k = 2) AS c2, max(v) FILTER (k = 3) AS c3 FROM k4 GROUP BY ALL)"""
query("label_clean", "px", _CLEAN + "SELECT scene_id, r, c, CASE WHEN c3 = 1 THEN 3 WHEN pred_cls = 3 THEN 0 WHEN c2 = 1 THEN 2 WHEN pred_cls = 2 THEN 0 WHEN c1 = 1 THEN 1 WHEN pred_cls = 1 THEN 0 ELSE pred_cls END AS label FROM px JOIN kw USING (scene_id, r, c)")(
    lambda px: R.clean_labels(px, SCENE, "pred_cls", [1, 2, 3]).withColumnRenamed("pred_cls", "label")
)


# --- regions ---------------------------------------------------------------------------------------------------------
def _flood(mask: str, keys: str, near: str = "abs(b.r - a.r) + abs(b.c - a.c) = 1") -> str:
    """CTEs with cc(keys, r, c, label): connected regions by transitive closure."""
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f""", m AS ({mask}), e AS (SELECT {a_keys}, a.r * 64 + a.c AS s, b.r * 64 + b.c AS t FROM m a JOIN m b ON {same} AND {near}),
f AS (SELECT {keys}, r * 64 + c AS s, r * 64 + c AS t FROM m UNION SELECT {", ".join("f." + k for k in keys.split(", "))}, f.s, e.t FROM f JOIN e ON {" AND ".join(f"e.{k} = f.{k}" for k in keys.split(", "))} AND e.s = f.t),
cc AS (SELECT {keys}, s // 64 AS r, s % 64 AS c, min(t) AS label FROM f GROUP BY {keys}, s)"""


_CC = _flood("SELECT scene_id, r, c FROM px WHERE prob >= 0.8", "scene_id")


def _regions(px):
    return CC.components(px.where("prob >= 0.8"), SCENE, 64)


query("components", "px", _CC + "SELECT scene_id, r, c, label FROM cc")(_regions)
query("remove_small", "px", _CC + ", z AS (SELECT *, count(*) OVER (PARTITION BY scene_id, label) AS n FROM cc) SELECT scene_id, r, c, label, n FROM z WHERE n >= 5")(lambda px: CC.remove_small(_regions(px), SCENE, 5).select("scene_id", "r", "c", "label", "n"))
#: Pixels of 10 m from (500, 9000) down: x = 10 c + 500, y = -10 r + 9000.
AFFINE = (10.0, 500.0, -10.0, 9000.0)


def _edges_sql(keys: str) -> str:
    """CTE ed(keys, label, edges): sides of a region's pixels that are not sides of another of its pixels."""
    return f", sd AS (SELECT {keys}, label, r, c, dr, dc FROM cc, (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS v(dr, dc))), ed AS (SELECT {keys}, label, count(*) AS edges FROM sd WHERE NOT EXISTS (SELECT 1 FROM cc n WHERE {' AND '.join(f'n.{k} = sd.{k}' for k in keys.split(', '))} AND n.label = sd.label AND n.r = sd.r + sd.dr AND n.c = sd.c + sd.dc) GROUP BY {keys}, label)"


def outlined(labelled, keys, least=1, conn=4):
    """Regions of enough pixels with the area and length of their outlines; holes turn the other way and count as less."""
    found = cut(CC.regions(labelled, keys).where(F.col("n") >= least))
    big = labelled.join(found.select(*keys, "label"), [*keys, "label"], "left_semi")
    measured = OL.measures(OL.paths(big, keys, conn), keys, AFFINE)
    return found.join(measured, [*keys, "label"]).withColumn("area_m2", F.round("area", 3)).withColumn("perimeter_m", F.round("perimeter", 3))


query("polygonize", "px", _CC + _edges_sql("scene_id") + "SELECT scene_id, label, count(*) * 100.0::DOUBLE AS area_m2, any_value(edges) * 10.0::DOUBLE AS perimeter_m, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, round(avg(c), 6) AS cx, round(avg(r), 6) AS cy FROM cc JOIN ed USING (scene_id, label) GROUP BY scene_id, label HAVING count(*) >= 3")(
    lambda px: outlined(_regions(px), SCENE, 3).select("scene_id", "label", "area_m2", "perimeter_m", "r0", "r1", "c0", "c1", F.round("cc", 6).alias("cx"), F.round("cr", 6).alias("cy"))
)
_CC8 = _flood("SELECT scene_id, pred_cls AS cls, r, c FROM px WHERE pred_cls > 0 AND prob >= 0.8", "scene_id, cls", "abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND (b.r, b.c) <> (a.r, a.c)")


def _typed(px):
    rows = px.where("pred_cls > 0 AND prob >= 0.8").select("scene_id", F.col("pred_cls").alias("cls"), "r", "c")
    return outlined(CC.components(rows, ["scene_id", "cls"], 64, conn=8), ["scene_id", "cls"], 2, conn=8)


query("polygonize_typed", "px", _CC8 + _edges_sql("scene_id, cls") + "SELECT scene_id, cls, label, count(*) * 100.0::DOUBLE AS area_m2, any_value(edges) * 10.0::DOUBLE AS perimeter_m, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cc JOIN ed USING (scene_id, cls, label) GROUP BY scene_id, cls, label HAVING count(*) >= 2")(lambda px: _typed(px).select("scene_id", "cls", "label", "area_m2", "perimeter_m", "r0", "r1", "c0", "c1"))
#: Names of typed change classes (fixed values).
CHANGE = {1: "building/impervious", 2: "road/linear", 3: "vegetation_loss", 4: "water_wetland_change"}
_TYPED = ", ty AS (SELECT scene_id, pred_cls + (CASE WHEN prob >= 0.9 THEN 2 ELSE 0 END) AS cls FROM px)"


def typed_filter(px, cls, least=5, pixel_area=100.0):
    """Areas of the change classes by name; class 0 is no change, and a class without a name is unknown."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in CHANGE.items() for x in kv]), F.col("cls").cast("int"))
    sums = px.withColumn("cls", cls).where("cls <> 0").groupBy("scene_id", "cls").agg((F.count("*") * pixel_area).alias("area"))
    return sums.where(F.col("area") >= least * pixel_area).select("scene_id", "cls", F.coalesce(name, F.lit("unknown")).alias("name"), "area")


query("typed_filter", "px", _TYPED + "SELECT scene_id, cls, CASE cls WHEN 1 THEN 'building/impervious' WHEN 2 THEN 'road/linear' WHEN 3 THEN 'vegetation_loss' WHEN 4 THEN 'water_wetland_change' ELSE 'unknown' END AS name, count(*) * 100.0::DOUBLE AS area FROM ty WHERE cls <> 0 GROUP BY ALL HAVING count(*) >= 5")(
    lambda px: typed_filter(px, F.col("pred_cls") + F.when(F.col("prob") >= 0.9, 2).otherwise(0))
)


@query("dissolve_tiles", "px", ", g AS (SELECT scene_id // 2 AS strip, r, c + scene_id % 2 * 64 AS c FROM px WHERE prob >= 0.9)" + _flood("SELECT strip, r, c FROM g", "strip").replace("* 64", "* 128").replace("// 64", "// 128").replace("% 64", "% 128") + "SELECT strip, label, count(*) AS n, min(c) AS c0, max(c) AS c1 FROM cc GROUP BY ALL")
def dissolve_tiles(px):
    """Regions over two scenes side by side: those that touch the common border become one."""
    strips = px.where("prob >= 0.9").select(F.expr("scene_id div 2").alias("strip"), "r", (F.col("c") + F.col("scene_id") % 2 * 64).alias("c"))
    return CC.regions(CC.components(strips, ["strip"], 128), ["strip"]).select("strip", "label", "n", "c0", "c1")


#: The grid of thresholds and least areas. Probabilities have one digit, so regions change at tenths only.
THRESHOLDS, AREAS = [k / 100 for k in range(1, 100)], [1, 5, 20]
_GRID = _flood("SELECT t AS tenth, scene_id, r, c FROM px, (SELECT unnest(range(1, 11)) AS t) WHERE prob >= t / 10.0::DOUBLE", "tenth, scene_id") + """, z AS (SELECT *, count(*) OVER (PARTITION BY tenth, scene_id, label) AS n FROM cc),
g AS (SELECT t AS tenth, a AS min_area, p.gt, coalesce(z.n, 0) >= a AS hit FROM px p, (SELECT unnest(range(1, 11)) AS t), (SELECT unnest([1, 5, 20]) AS a) LEFT JOIN z ON z.tenth = t AND z.scene_id = p.scene_id AND z.r = p.r AND z.c = p.c WHERE p.gt <> 255),
s AS (SELECT tenth, min_area, count(*) FILTER (hit AND gt = 1) AS tp, count(*) FILTER (hit AND gt = 0) AS fp, count(*) FILTER (NOT hit AND gt = 1) AS fn FROM g GROUP BY ALL),
w AS (SELECT k / 100.0::DOUBLE AS thr, min_area, tp, fp, fn, round(2.0::DOUBLE * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM s JOIN (SELECT unnest(range(1, 100)) AS k) ON (k + 9) // 10 = tenth)"""


def area_sweep(px):
    """Scores over a grid of thresholds and least areas, from one tree of regions."""
    swept = CT.area_sweep(px, SCENE, "prob", "gt", THRESHOLDS, AREAS, 64)
    return swept.withColumn("f1", F.round(2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6))


query("threshold_minarea_sweep", "px", _GRID + "SELECT * FROM w")(area_sweep)
query("sweep_pivot", "px", _GRID + "SELECT min_area, max(f1) FILTER (thr = 0.8) AS t80, max(f1) FILTER (thr = 0.9) AS t90 FROM w GROUP BY min_area")(lambda px: area_sweep(px).groupBy("min_area").pivot("thr", [0.8, 0.9]).agg(F.first("f1")).toDF("min_area", "t80", "t90"))


_CC5 = _flood("SELECT scene_id, r, c FROM px WHERE prob >= 0.5", "scene_id")
_KM = "pow(6400 / 200000.0::DOUBLE / 64 * 111.32::DOUBLE * cos(radians(18 + (scene_id // 10 % 10 * 10000 + 3200) / 200000.0::DOUBLE)), 2)"
_REPORT = f""", z AS (SELECT scene_id, count(*) AS regions, sum(n) AS big FROM (SELECT scene_id, label, count(*) AS n FROM cc GROUP BY ALL HAVING count(*) > 50) GROUP BY scene_id),
s AS (SELECT scene_id, count(*) AS n, count(*) FILTER (prob >= 0.5) AS k FROM px GROUP BY scene_id),
d AS (SELECT aoi_id AS scene_id, min(CAST(datetime AS DATE)) AS t0, max(CAST(datetime AS DATE)) AS t1 FROM scene_items GROUP BY aoi_id)
SELECT scene_id, round(100.0::DOUBLE * k / n, 6) AS pct, coalesce(regions, 0) AS regions, round(coalesce(big, 0) * {_KM}, 9) AS km2, ((year(t1) - year(t0)) * 12 + month(t1) - month(t0))::INT AS months,
CASE WHEN 100.0 * k / n < 0.5 THEN 'minimal' WHEN 100.0 * k / n < 2 THEN 'low' WHEN 100.0 * k / n < 5 THEN 'moderate' ELSE 'high' END AS severity FROM s LEFT JOIN z USING (scene_id) LEFT JOIN d USING (scene_id)"""


@query("aoi_change_report", "px scene_items", _CC5 + _REPORT)
def aoi_change_report(px, items, least=50):
    """Change share, regions of more than 50 pixels and their area by the latitude of the scene (200 km a degree in both
    directions here, 6.4 km a scene), months between the AOI's first and last scene, and a severity class."""
    big = CC.regions(CC.components(px.where("prob >= 0.5"), SCENE, 64), SCENE).where(F.col("n") > least)
    found = big.groupBy("scene_id").agg(F.count("*").alias("regions"), F.sum("n").alias("big"))
    s = px.groupBy("scene_id").agg(F.count("*").alias("n"), n_if(F.col("prob") >= 0.5).alias("k"))
    dates = items.groupBy(F.col("aoi_id").alias("scene_id")).agg(F.to_date(F.min("datetime")).alias("t0"), F.to_date(F.max("datetime")).alias("t1"))
    lat = 18 + (F.expr("scene_id div 10 % 10") * 10000 + 3200) / 200000.0
    km = 6400 / 200000.0 / 64 * 111.32 * F.cos(F.radians(lat))
    pct = 100.0 * F.col("k") / F.col("n")
    severity = F.when(pct < 0.5, "minimal").when(pct < 2, "low").when(pct < 5, "moderate").otherwise("high")
    return s.join(found, "scene_id", "left").join(dates, "scene_id", "left").select("scene_id", F.round(pct, 6).alias("pct"), F.coalesce("regions", F.lit(0)).alias("regions"), F.round(F.coalesce("big", F.lit(0)) * km * km, 9).alias("km2"), SC.months_apart("t0", "t1").alias("months"), severity.alias("severity"))
