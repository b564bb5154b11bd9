"""Queries that write tables in the layouts of users' files, read them back, stream them, or run user code on them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terradelta.checkpoints import shared_folder
from terradelta.functions import geometry as G
from terradelta.operators import extension as X
from terradelta.plans.registry import query
from terradelta.sinks import writers as W
from terradelta.sources import readers as R
from terradelta.streaming import incremental as ST


def _new(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_scene_json", "scene_items", "SELECT id, collection, source_endpoint, CAST(CAST(datetime AS DATE) AS VARCHAR) AS day, round(cloud, 4) AS cloud, 's3://' || event_id AS href FROM scene_items")
def scan_scene_json(items):
    """Half of the AOIs' items in documents that wrap a list, half as bare items; both read into one schema."""
    spark, path = items.sparkSession, _new(items.sparkSession, "scenes")
    props = F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud").alias("eo:cloud_cover"))
    item = F.struct("id", props.alias("properties"), F.create_map(F.lit("B04"), F.struct(F.concat(F.lit("s3://"), F.col("event_id").cast("string")).alias("href"))).alias("assets"))
    one = items.select("aoi_id", F.col("event_id") % 64 % 8, "collection", "source_endpoint", item.alias("item")).toDF("aoi_id", "page", "collection", "source_endpoint", "item")
    pages = one.where("aoi_id % 2 = 0").groupBy("aoi_id", "page").agg(F.collect_list(F.struct("collection", "source_endpoint", "item")).alias("items"))
    pages.select(F.struct(F.lit("2024-01-01").alias("start")).alias("search_metadata"), "items").write.json(path)
    one.where("aoi_id % 2 = 1").select("collection", "source_endpoint", "item").write.mode("append").json(path)
    read = R.read_scene_items(spark, path)
    return read.select("id", "collection", "source_endpoint", F.to_date("datetime").cast("string").alias("day"), F.round("cloud", 4).alias("cloud"), F.element_at("assets", "b04").alias("href"))


def _ring():
    return G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("scan_geojson", "zones", "SELECT zone_id, 'Polygon' AS geom_type, 5 AS corners, xmin, ymax FROM zones")
def scan_geojson(z):
    path = _new(z.sparkSession, "geojson")
    W.write_geojson(z.withColumn("parts", F.array(F.array(_ring()))), path, "parts", "zone_id", "w")
    box = G.bbox(F.col("ring"))
    return R.read_geojson(z.sparkSession, path).select(F.get_json_object("props", "$.zone_id").cast("long").alias("zone_id"), "geom_type", F.size("ring").alias("corners"), box["xmin"].alias("xmin"), box["ymax"].alias("ymax"))


#: Corners of a zone's parts by share of its box, as corners of its first part, of a hole in that and of its second part.
_FX = "[0.0, 1.0, 0.9, 0.5, 0.05, 0.3, 0.6, 0.45, 1.1, 1.4, 1.2]::DOUBLE[]"
_FY = "[0.0, 0.1, 1.0, 0.45, 0.9, 0.15, 0.12, 0.35, 0.2, 0.25, 0.6]::DOUBLE[]"
_LON, _LAT = (t.replace("300000.0D", "300000.0::DOUBLE").replace("2000000.0D", "2000000.0::DOUBLE") for t in G.to_wgs84("(300000.0D + x)", "(2000000.0D + y)", "32643"))


@query("write_geojson", "zones", f", p AS (SELECT zone_id, xmin + unnest({_FX}) * w + 7.3::DOUBLE AS x, ymin + unnest({_FY}) * h + 7.3::DOUBLE AS y FROM zones) SELECT zone_id, 'MultiPolygon' AS geom_type, 2 AS parts, 1 AS holes, round(min({_LON}), 6) AS lon0, round(min({_LAT}), 6) AS lat0, round(max({_LON}), 6) AS lon1, round(max({_LAT}), 6) AS lat1 FROM p GROUP BY zone_id")
def write_geojson(z):
    """Polygons of two parts, one with a hole, written in WGS84 and read back."""
    from terradelta.plans.spatial_queries import EAST, NORTH, zone_polygons

    path = _new(z.sparkSession, "geojson")
    moved = F.transform("rings", lambda ring: F.transform(ring, lambda p: G.point(p["x"] + EAST, p["y"] + NORTH)))
    parts = zone_polygons(z).withColumn("rings", moved).withColumn("parts", F.array(F.slice("rings", 1, 2), F.slice("rings", 3, 1)))
    W.write_geojson(parts, path, "parts", "zone_id", zone="32643")
    back = R.read_geojson(z.sparkSession, path).withColumn("b", G.bbox(F.col("ring"))).withColumn("zone_id", F.get_json_object("props", "$.zone_id").cast("long"))
    ends = [F.round(f(f"b.{c}"), 6).alias(n) for f, c, n in ((F.min, "xmin", "lon0"), (F.min, "ymin", "lat0"), (F.max, "xmax", "lon1"), (F.max, "ymax", "lat1"))]
    return back.groupBy("zone_id", "geom_type").agg(F.count("*").cast("int").alias("parts"), F.sum(F.size("holes")).cast("int").alias("holes"), *ends)


@query("scan_osm_elements", "roads", "SELECT 'node' AS kind, road_id * 10 AS id, 2 AS size FROM roads UNION ALL SELECT 'way', road_id, 2 FROM roads")
def scan_osm_elements(r):
    path = _new(r.sparkSession, "osm")
    node = F.struct(F.lit("node").alias("type"), (F.col("road_id") * 10).alias("id"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    way = F.struct(F.lit("way").alias("type"), F.col("road_id").alias("id"), F.array(F.col("road_id") * 10, F.col("road_id") * 10 + 1).alias("nodes"), F.create_map(F.lit("highway"), F.lit("road")).alias("tags"))
    r.select(F.concat(F.lit('{"elements": ['), F.to_json(node), F.lit(", "), F.to_json(way), F.lit("]}")).alias("value")).write.text(path)
    nodes, ways = R.read_osm(r.sparkSession, path)
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit(2).alias("size")).unionByName(ways.select(F.lit("way").alias("kind"), "id", F.size("nodes").alias("size")))


@query("scan_history", "history", "SELECT run, epoch, val_loss, round(lr, 9) AS lr FROM history")
def scan_history(h):
    path = _new(h.sparkSession, "history")
    rows = h.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "val_loss", "lr"))).alias("e"))
    rows.select("run", F.struct(*[F.col(f"e.{c}").alias(c) for c in ("epoch", "val_loss", "lr")]).alias("history")).write.json(path)
    return R.read_history(h.sparkSession, path).select("run", "epoch", "val_loss", F.round("lr", 9).alias("lr"))


@query("scan_manifest", "chips", "SELECT DISTINCT 'split=' || split AS dir, '.parquet' AS ext FROM chips")
def scan_manifest(c):
    path = _new(c.sparkSession, "index")
    W.write_index(c.select("chip_id", "split"), path)
    return R.read_manifest(c.sparkSession, path, "*.parquet").select("dir", "ext").distinct()


@query("scan_chip_arrays", "chips", "SELECT chip_id, 64 AS n, 'float32' AS dtype, round(list_sum(list_transform(t0, lambda x: CASE WHEN isnan(x) THEN 0 ELSE x END)), 4) AS total FROM chips")
def scan_chip_arrays(c):
    """Chips as .npy contents and back."""
    shaped = c.select("chip_id", "t0", F.array(*[F.lit(4)] * 3).alias("shape"))
    back = R.decode_npy(R.encode_npy(shaped, "chip_id", "t0", "shape"), "chip_id")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.nanvl(x, F.lit(0.0).cast("float")).cast("double"))
    return back.select("chip_id", F.aggregate("shape", F.lit(1), lambda a, x: a * x).alias("n"), "dtype", F.round(total, 4).alias("total"))


@query("scan_images", "cls_px", ", g AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY r, c) - 1 AS k, pred FROM cls_px) SELECT 'scene_' || scene_id AS origin, 3 AS channels, count(*) AS n, round(sum(pred * 60 / 255.0::DOUBLE), 2) AS red, round(sum(pred * 60 / 255.0::DOUBLE * (k % 11)), 2) AS placed FROM g GROUP BY scene_id")
def scan_images(px):
    """Rows of Spark's image schema (blue, green, red bytes), one image of a row of pixels in their order per scene, to RGB
    arrays. An image is one value of its row."""
    pixel = F.concat(F.lit("0001"), F.lpad(F.hex(F.col("pred") * 60), 2, "0"))
    rows = px.groupBy("scene_id").agg(F.count("*").cast("int").alias("width"), F.array_sort(F.collect_list(F.struct("r", "c", pixel.alias("x")))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), "")).alias("data")
    image = F.struct(F.concat(F.lit("scene_"), F.col("scene_id").cast("string")).alias("origin"), F.lit(1).alias("height"), "width", F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data)
    arrays = R.rgb_arrays(rows.select(image.alias("image")))
    total = lambda weight: F.aggregate(F.transform("reds", weight), F.lit(0.0), lambda a, x: a + x)
    reds = arrays.withColumn("reds", F.filter("values", lambda x, i: i % 3 == 0))
    return reds.select("origin", "channels", F.col("width").cast("long").alias("n"), F.round(total(lambda x: x.cast("double")), 2).alias("red"), F.round(total(lambda x, i: x.cast("double") * (i % 11)), 2).alias("placed"))


# --- sinks -----------------------------------------------------------------------------------------------------------
@query("write_index", "chips", "SELECT chip_id, split FROM chips")
def write_index(c):
    path = _new(c.sparkSession, "index")
    W.write_index(c.select("chip_id", "split"), path)
    return R.read_index(c.sparkSession, path, "chip_id", "split")


@query("write_csv_report", "quality", "SELECT name, valid_ratio, '{\"finite\":' || finite_count || '}' AS counts FROM quality")
def write_csv_report(q):
    path = _new(q.sparkSession, "report")
    W.write_csv(q.select("name", "valid_ratio", F.create_map(F.lit("finite"), F.col("finite_count")).alias("counts")), path)
    return q.sparkSession.read.schema("name string, valid_ratio double, counts string").csv(path, header=True, escape='\\')


@query("append_metrics_log", "history", "SELECT run, epoch, val_loss FROM history")
def append_metrics_log(h):
    path = _new(h.sparkSession, "log")
    rows = h.select("run", "epoch", "val_loss")
    for even in (0, 1):
        W.append_log(rows.where(F.col("epoch") % 2 == even), path)
    return h.sparkSession.read.parquet(path)


@query("write_chip_arrays", "chips", "SELECT chip_id, len(t0) AS n FROM chips")
def write_chip_arrays(c):
    path = _new(c.sparkSession, "chips")
    W.write_arrays(c.select("chip_id", "t0", "t1"), path)
    return c.sparkSession.read.parquet(path).select("chip_id", F.size("t0").cast("long").alias("n"))


@query("write_raster", "px", "SELECT scene_id, r, c, prob, (scene_id % 10) * 10000 + c * 100 + 50.0::DOUBLE AS x, (scene_id // 10 % 10) * 10000 + (63 - r) * 100 + 50.0::DOUBLE AS y, 'EPSG:32643' AS crs FROM px")
def write_raster(px):
    """Each scene's own place, and pixels' centres by the affine that is read back."""
    path = _new(px.sparkSession, "raster")
    s = F.col("scene_id")
    W.write_raster(px, path, "prob", affine=W.north_up(s % 10 * 10000.0, F.expr("scene_id div 10 % 10") * 10000.0 + 6400, 100.0), crs="EPSG:32643")
    back = px.sparkSession.read.parquet(path).select(F.col("scene_id").cast("long").alias("scene_id"), "affine", "crs", F.inline("cells"))
    at = lambda *k: F.col(f"affine.{k[0]}") * (F.col("c") + 0.5) + F.col(f"affine.{k[1]}") * (F.col("r") + 0.5) + F.col(f"affine.{k[2]}")
    return back.select("scene_id", "r", "c", F.col("v").alias("prob"), at("a", "b", "c").alias("x"), at("d", "e", "f").alias("y"), "crs")


@query("write_empty", "alerts", "SELECT unnest(['csv', 'geojson', 'parquet']) AS sink, count(*) AS n, unnest(['alert_id,area_m2', '', 'alert_id,area_m2']) AS columns FROM alerts WHERE w < 0")
def write_empty(a):
    """No alert passes; every sink still holds what its readers take: columns, or a collection without features."""
    spark, path = a.sparkSession, _new(a.sparkSession, "alerts")
    none = a.where("w < 0").withColumn("area_m2", F.col("w") * F.col("h")).withColumn("parts", F.array(F.array(_ring())))
    W.write_csv(none.select("alert_id", "area_m2"), f"{path}/csv")
    W.write_geojson(none, f"{path}/geojson", "parts", "alert_id")
    none.select("alert_id", "area_m2").write.parquet(f"{path}/parquet")
    csv, features, table = spark.read.csv(f"{path}/csv", header=True), R.read_geojson(spark, f"{path}/geojson"), spark.read.parquet(f"{path}/parquet")
    rows = [d.agg(F.lit(n).alias("sink"), F.count("*").alias("n"), F.lit(",".join(c for c in d.columns if n != "geojson")).alias("columns")) for n, d in (("csv", csv), ("geojson", features), ("parquet", table))]
    return rows[0].union(rows[1]).union(rows[2])


@query("write_summary_json", "px", "SELECT count(*) AS pixels, count(DISTINCT scene_id) AS scenes, round(avg(prob), 6) AS mean FROM px")
def write_summary_json(px):
    path = _new(px.sparkSession, "summary")
    W.write_json(px.agg(F.count("*").alias("pixels"), F.count_distinct("scene_id").alias("scenes"), F.round(F.avg("prob"), 6).alias("mean")), path)
    return px.sparkSession.read.schema("pixels long, scenes long, mean double").json(path)


# --- streams ---------------------------------------------------------------------------------------------------------
query("stream_scene_ingest", sql="SELECT DISTINCT user_id || '_' || CAST(ts AS DATE) AS id FROM events")(lambda spark, sf_dir: ST.run_once(ST.ingest_scenes(ST.events(spark, sf_dir)), ST.fresh(spark, "ingest")).select("id"))
query("stream_metrics_log", sql="SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY day")(
    lambda spark, sf_dir: ST.run_once(ST.daily_metrics(ST.events(spark, sf_dir)), ST.fresh(spark, "metrics"), "update").groupBy("day").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("mean", "batch"), 6).alias("mean"))
)

# --- user code -------------------------------------------------------------------------------------------------------
_N = "CASE WHEN isnan(x) THEN 0 ELSE round(x, 6) END"
query("udf_augment", "chips", f"SELECT chip_id, {_N} AS corner FROM (SELECT chip_id, t0[4] AS x FROM chips)")(lambda c: X.augment(c, lambda a, b: (a[:, :, ::-1], b[:, :, ::-1])).select("chip_id", F.nanvl(F.round(F.col("t0")[0], 6), F.lit(0.0)).alias("corner")))
query("udf_scorer", "chips", "SELECT chip_id, round(list_max(list_transform(range(1, 65), lambda i: CASE WHEN isnan(t0[i]) OR isnan(t1[i]) THEN 0 ELSE abs(t1[i] - t0[i]) END)), 6) AS score FROM chips")(
    lambda c: X.score(c, lambda: lambda a, b: __import__("numpy").nan_to_num(abs(b - a)).max()).select("chip_id", F.round("score", 6).alias("score"))
)
query("udaf_metric", "px", "SELECT scene_id, count(*) FILTER (prob >= 0.7 AND gt = 1) AS tp, count(*) FILTER (prob >= 0.7 AND gt = 0) AS fp, count(*) FILTER (prob < 0.7 AND gt = 1) AS fn FROM px GROUP BY scene_id")(lambda px: px.groupBy("scene_id").agg(*X.thresholded(F.col("prob"), F.col("gt"), 0.7)))
query("metric_algebra", "px", "SELECT round(avg((prob - gt) * (prob - gt)) + 0.5::DOUBLE * avg(abs(prob - gt)), 6) AS loss FROM px WHERE gt <> 255")(lambda px: px.where("gt <> 255").agg(F.round((X.criterion("mse", F.col("prob"), F.col("gt")) + 0.5 * X.criterion("l1", F.col("prob"), F.col("gt"))).column, 6).alias("loss")))
query("criterion_by_name", "px", "SELECT round(avg((prob - gt) * (prob - gt)), 6) AS mse, round(avg(abs(prob - gt)), 6) AS l1, round(1 - 2 * sum(prob * gt) / greatest(sum(prob) + sum(gt), 1e-7), 6) AS dice, round(avg(-ln(greatest(CASE WHEN gt = 1 THEN prob ELSE 1 - prob END, 1e-7))), 5) AS bce FROM px WHERE gt <> 255")(
    lambda px: px.where("gt <> 255").agg(*[F.round(X.criterion(n, F.col("prob"), F.col("gt")).column, 5 if n == "bce" else 6).alias(n) for n in X.CRITERIA])
)


@query("udtf_windows", sql="SELECT s AS scene_id, y.o AS y, x.o AS x FROM (SELECT DISTINCT l_orderkey // 1000 AS s FROM lineitem), (SELECT unnest([0, 16, 32, 48]) AS o) y, (SELECT unnest([0, 16, 32, 48]) AS o) x")
def udtf_windows(spark, sf_dir):
    from terradelta.fixtures import px

    X.register_windows(spark)
    px(spark, sf_dir).select("scene_id").distinct().createOrReplaceTempView("scenes_for_windows")
    return spark.sql("SELECT scene_id, w.y, w.x FROM scenes_for_windows, LATERAL tile_windows(64, 64, 16) w")
