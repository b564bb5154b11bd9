"""Scene, chip, pixel and vector tables derived from the star-schema tables, in Spark and as the same views in DuckDB SQL.

Every view is lazy; nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(key):
    """A stable bucket 0..99 of a key's text."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pixels: scene_id, r, c, prob, gt (0, 1, 255 = ignore), pred_cls; one row per (scene_id, r, c)."""
    pixel = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 1000").alias("scene_id"),
        (F.col("l_partkey") % 64).alias("r"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 64).alias("c"),
        F.round(F.col("l_discount") * 10, 1).alias("prob"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 255 END").alias("gt"),
        (F.col("l_linenumber") % 4).alias("pred_cls"),
    )
    return pixel.groupBy("scene_id", "r", "c").agg(F.max("prob").alias("prob"), F.max("gt").alias("gt"), F.max("pred_cls").alias("pred_cls"))


def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover code of each pixel; 0 = no data."""
    codes = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0)])
    at = F.expr("(r div 4 * 5 + c div 4 * 7 + scene_id) % 12").cast("int")
    return px(spark, sf_dir).select("scene_id", "r", "c", F.element_at(codes, at + 1).alias("code"))


def cls_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a predicted class 0..3 and a label 0..3, or 255 where the pixel is ignored."""
    label = F.when(F.col("gt") == 255, 255).otherwise((F.col("r") * 3 + F.col("c") * 5 + F.col("scene_id")) % 4).cast("int")
    return px(spark, sf_dir).select("scene_id", "r", "c", F.col("pred_cls").alias("pred"), label.alias("label"))


def split_of(key):
    b = bucket(key)
    return F.when(b < 10, "val").when(b < 20, "test").otherwise("train")


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip pairs: chip_id, split, t0 and t1 arrays of [4 bands, 4 rows, 4 columns]; values under -0.3 are NaN (masked)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = F.max(F.when(F.col("vec_id") % 2 == 0, F.col("v"))).alias("t0")
    second = F.max(F.when(F.col("vec_id") % 2 == 1, F.col("v"))).alias("t1")
    pairs = e.groupBy(F.expr("vec_id div 2").alias("chip_id")).agg(first, second).where("t0 IS NOT NULL AND t1 IS NOT NULL")
    masked = lambda c: F.transform(c, lambda x: F.when(x < -0.3, F.lit(float("nan"))).otherwise(x)).alias(c)
    return pairs.select("chip_id", split_of(F.col("chip_id") * 2).alias("split"), masked("t0"), masked("t1"))


def chip_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the chips: chip_id, split, band, r, c, v0, v1."""
    both = chips(spark, sf_dir).select("chip_id", "split", F.posexplode(F.arrays_zip("t0", "t1")).alias("i", "v"))
    return both.select("chip_id", "split", F.expr("i div 16").alias("band"), F.expr("cast(i % 16 div 4 as bigint)").alias("r"), (F.col("i") % 4).cast("long").alias("c"), F.col("v.t0").alias("v0"), F.col("v.t1").alias("v1"))


def scene_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue: id, aoi_id, datetime, cloud, collection, source_endpoint, props, event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("id"),
        F.col("user_id").alias("aoi_id"),
        F.col("ts").cast("timestamp").alias("datetime"),
        F.col("value").alias("cloud"),
        F.col("event_type").alias("collection"),
        F.when(F.col("event_id") % 2 == 0, "aws").otherwise("usgs").alias("source_endpoint"),
        "props",
        "event_id",
    )


def _box(df: DataFrame, key: str, name: str, xmin, ymin, w, h, *more) -> DataFrame:
    sized = df.select(F.col(key).cast("long").alias(name), *more, xmin.alias("xmin"), ymin.alias("ymin"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    return sized.withColumn("xmax", F.col("xmin") + F.col("w")).withColumn("ymax", F.col("ymin") + F.col("h"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return _box(o, "o_orderkey", "alert_id", (k * 7919) % 10000 * 10.0, (k * 104729) % 10000 * 10.0, 10 + (F.col("o_custkey") % 20) * 10, 10 + F.floor("o_totalprice") % 20 * 10)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _box(table(spark, sf_dir, "supplier"), "s_suppkey", "zone_id", (k * 6007) % 10000 * 10.0, (k * 3001) % 10000 * 10.0, F.lit(3000), F.lit(3000))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _box(table(spark, sf_dir, "customer"), "c_custkey", "bld_id", (k * 7393) % 10000 * 10.0, (k * 4409) % 10000 * 10.0, F.lit(400), F.lit(400))


def aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _box(table(spark, sf_dir, "nation"), "n_nationkey", "aoi_id", (k % 5) * 20000.0, F.expr("n_nationkey div 5") * 20000.0, F.lit(20000), F.lit(20000), F.col("n_name").alias("name"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: road_id, x1, y1, x2, y2."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 3571) % 10000 * 10.0, (k * 8837) % 10000 * 10.0
    return table(spark, sf_dir, "part").select(k.alias("road_id"), x.alias("x1"), y.alias("y1"), (x + s * 20.0).alias("x2"), (y + s * 10.0).alias("y2"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 27).alias("aoi_id"), (F.col("o_totalprice") / 500000).cast("double").alias("score"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: split, tag (A, B, label), name, path. Some stems lack B or label."""
    p = table(spark, sf_dir, "part").select("p_partkey", split_of(F.col("p_partkey")).alias("split"), F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("label"))).alias("tag"))
    kept = p.where(~((F.col("tag") == "B") & (F.col("p_partkey") % 7 == 0)) & ~((F.col("tag") == "label") & (F.col("p_partkey") % 11 == 0)))
    name = F.concat_ws("_", F.col("p_partkey").cast("string"), F.col("tag"))
    return kept.select("split", "tag", F.concat(name, F.lit(".npy")).alias("name"), F.concat_ws("/", "split", "tag", F.concat(name, F.lit(".npy"))).alias("path"), F.col("p_partkey").cast("string").alias("stem"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip-quality summary by file name: name, valid_ratio, finite_count. Some files are not listed."""
    p = table(spark, sf_dir, "part").where("p_partkey % 13 <> 0")
    return p.select(F.concat(F.col("p_partkey").cast("string"), F.lit("_A.npy")).alias("name"), ((F.col("p_size") % 11) / 10.0).alias("valid_ratio"), (F.col("p_size") % 11 * 10).cast("long").alias("finite_count"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training history: run, epoch, val_loss, f1, lr."""
    from pyspark.sql.window import Window

    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.round(F.avg("o_totalprice") / 1e6, 6).alias("val_loss"))
    ranked = months.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("m")))
    return ranked.select("run", F.col("epoch").cast("long").alias("epoch"), "val_loss", F.round(1 - F.col("val_loss"), 6).alias("f1"), (0.001 / F.pow(F.lit(2.0), F.expr("(epoch - 1) div 10"))).alias("lr"))


def _bucket_sql(key: str) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT % 100)"


def split_sql(key: str) -> str:
    b = _bucket_sql(key)
    return f"CASE WHEN {b} < 10 THEN 'val' WHEN {b} < 20 THEN 'test' ELSE 'train' END"


def _box_sql(body: str) -> str:
    return f"SELECT *, xmin + w AS xmax, ymin + h AS ymax FROM ({body})"


SQL: dict[str, str] = {
    "px": """SELECT l_orderkey // 1000 AS scene_id, l_partkey % 64 AS r, (l_orderkey * 7 + l_linenumber) % 64 AS c, max(round(l_discount * 10, 1)) AS prob,
  max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 255 END) AS gt, max(l_linenumber % 4) AS pred_cls FROM lineitem GROUP BY ALL""",
    "land_cover": "SELECT scene_id, r, c, [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 0][(r // 4 * 5 + c // 4 * 7 + scene_id) % 12 + 1] AS code FROM px",
    "cls_px": "SELECT scene_id, r, c, pred_cls AS pred, (CASE WHEN gt = 255 THEN 255 ELSE (r * 3 + c * 5 + scene_id) % 4 END)::INT AS label FROM px",
    "chips": f"""SELECT a.vec_id // 2 AS chip_id, {split_sql("a.vec_id")} AS split,
  list_transform(a.embedding, lambda x: CASE WHEN x::DOUBLE < -0.3 THEN 'NaN'::DOUBLE ELSE x::DOUBLE END) AS t0,
  list_transform(b.embedding, lambda x: CASE WHEN x::DOUBLE < -0.3 THEN 'NaN'::DOUBLE ELSE x::DOUBLE END) AS t1
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
    "chip_px": """SELECT chip_id, split, i // 16 AS band, i % 16 // 4 AS r, i % 4 AS c, t0[i + 1] AS v0, t1[i + 1] AS v1
  FROM (SELECT *, unnest(range(64)) AS i FROM chips)""",
    "scene_items": """SELECT user_id || '_' || CAST(ts AS DATE) AS id, user_id AS aoi_id, ts AS datetime, value AS cloud, event_type AS collection,
  CASE WHEN event_id % 2 = 0 THEN 'aws' ELSE 'usgs' END AS source_endpoint, props, event_id FROM events""",
    "alerts": _box_sql("""SELECT o_orderkey AS alert_id, ((o_orderkey * 7919) % 10000 * 10)::DOUBLE AS xmin, ((o_orderkey * 104729) % 10000 * 10)::DOUBLE AS ymin,
  (10 + (o_custkey % 20) * 10)::DOUBLE AS w, (10 + CAST(floor(o_totalprice) AS BIGINT) % 20 * 10)::DOUBLE AS h FROM orders"""),
    "zones": _box_sql("SELECT s_suppkey AS zone_id, ((s_suppkey * 6007) % 10000 * 10)::DOUBLE AS xmin, ((s_suppkey * 3001) % 10000 * 10)::DOUBLE AS ymin, 3000::DOUBLE AS w, 3000::DOUBLE AS h FROM supplier"),
    "buildings": _box_sql("SELECT c_custkey AS bld_id, ((c_custkey * 7393) % 10000 * 10)::DOUBLE AS xmin, ((c_custkey * 4409) % 10000 * 10)::DOUBLE AS ymin, 400::DOUBLE AS w, 400::DOUBLE AS h FROM customer"),
    "aoi": _box_sql("SELECT n_nationkey::BIGINT AS aoi_id, n_name AS name, ((n_nationkey % 5) * 20000)::DOUBLE AS xmin, ((n_nationkey // 5) * 20000)::DOUBLE AS ymin, 20000::DOUBLE AS w, 20000::DOUBLE AS h FROM nation"),
    "roads": """SELECT p_partkey AS road_id, ((p_partkey * 3571) % 10000 * 10)::DOUBLE AS x1, ((p_partkey * 8837) % 10000 * 10)::DOUBLE AS y1,
  ((p_partkey * 3571) % 10000 * 10 + p_size * 20)::DOUBLE AS x2, ((p_partkey * 8837) % 10000 * 10 + p_size * 10)::DOUBLE AS y2 FROM part""",
    "detections": "SELECT o_orderkey AS id, o_custkey % 27 AS aoi_id, o_totalprice / 500000 AS score FROM orders",
    "manifest": f"""SELECT split, tag, stem || '_' || tag || '.npy' AS name, split || '/' || tag || '/' || stem || '_' || tag || '.npy' AS path, stem FROM (
  SELECT p_partkey::VARCHAR AS stem, {split_sql("p_partkey")} AS split, unnest(['A', 'B', 'label']) AS tag, p_partkey FROM part)
  WHERE NOT (tag = 'B' AND p_partkey % 7 = 0) AND NOT (tag = 'label' AND p_partkey % 11 = 0)""",
    "quality": "SELECT p_partkey || '_A.npy' AS name, (p_size % 11) / 10.0::DOUBLE AS valid_ratio, (p_size % 11 * 10)::BIGINT AS finite_count FROM part WHERE p_partkey % 13 <> 0",
    "history": """SELECT run, epoch, val_loss, round(1 - val_loss, 6) AS f1, 0.001::DOUBLE / pow(2, (epoch - 1) // 10) AS lr FROM (
  SELECT run, val_loss, row_number() OVER (PARTITION BY run ORDER BY m) AS epoch FROM (
  SELECT o_orderstatus AS run, year(o_orderdate) * 12 + month(o_orderdate) AS m, round(avg(o_totalprice) / 1e6, 6) AS val_loss FROM orders GROUP BY ALL))""",
}
_NEEDS = {"land_cover": ["px"], "cls_px": ["px"], "chip_px": ["chips"]}


def with_views(sql: str, *views: str) -> str:
    """A query with the named views as CTEs before it; the query may start with more CTEs of its own, after a comma."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH RECURSIVE {ctes}{sql if sql.startswith(',') else chr(10) + sql}"


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (px, land_cover, cls_px, chips, chip_px, scene_items, alerts, zones, buildings, aoi, roads, detections, manifest, quality, history)}
