"""Queries on manifests, splits, catalogues and training histories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.checkpoints import shared_folder
from terradelta.fixtures import bucket, split_of, split_sql, table
from terradelta.functions import strings as S
from terradelta.functions import geometry as G
from terradelta.operators import manifest as MF
from terradelta.operators import scenes as SC
from terradelta.operators import splits as SP
from terradelta.plans.registry import query
from terradelta.sinks import writers as W
from terradelta.sources import readers as R


def _new(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _listed(m):
    """The manifest's rows whose names a text list has."""
    path = _new(m.sparkSession, "list")
    m.where(F.col("stem").cast("long") % 17 == 0).select("name").distinct().write.text(path)
    return R.filter_by_list(m, path, "name")


def _index(df, name, *columns):
    """The table written as Parquet and read by its required columns."""
    path = _new(df.sparkSession, name)
    df.write.parquet(path)
    return R.read_index(df.sparkSession, path, *columns)


def _summary(q):
    path = _new(q.sparkSession, "summary")
    W.write_csv(q, path)
    return R.read_summary_csv(q.sparkSession, path)


# --- manifests -------------------------------------------------------------------------------------------------------
_PIVOT = ", t AS (SELECT split, stem, min(path) FILTER (tag = 'A') AS A, min(path) FILTER (tag = 'B') AS B, min(path) FILTER (tag = 'label') AS label FROM manifest GROUP BY ALL)"
query("triple_pair", "manifest", _PIVOT + "SELECT * FROM t WHERE A IS NOT NULL AND B IS NOT NULL AND label IS NOT NULL")(lambda m: MF.complete(MF.triples(m, "split", "stem")))
query("triple_incomplete", "manifest", _PIVOT + "SELECT * FROM t WHERE A IS NULL OR B IS NULL OR label IS NULL")(lambda m: MF.incomplete(MF.triples(m, "split", "stem")))
query("triple_pair_prefix", "manifest", ", p AS (SELECT split, tag, path, regexp_replace(name, '_(A|B|OUT|label|mask)\\.npy$', '') AS prefix FROM manifest) SELECT prefix, min(path) FILTER (tag = 'A') AS A, min(path) FILTER (tag = 'B') AS B, min(path) FILTER (tag = 'label') AS label FROM p GROUP BY prefix")(
    lambda m: MF.triples(m.withColumn("prefix", S.prefix(S.stem(F.col("path")))), "prefix")
)
query("positional_pair", "manifest", ", a AS (SELECT split, path, row_number() OVER (PARTITION BY split ORDER BY path) AS k FROM manifest WHERE tag = 'A'), b AS (SELECT split, path, row_number() OVER (PARTITION BY split ORDER BY path) AS k FROM manifest WHERE tag = 'B') SELECT coalesce(a.split, b.split) AS split, coalesce(a.k, b.k)::INT AS k, a.path AS a, b.path AS b FROM a FULL JOIN b ON a.split = b.split AND a.k = b.k")(
    lambda m: MF.positional(m.where("tag = 'A'"), m.where("tag = 'B'"), "path", "split")
)
query("quality_double_lookup", "manifest quality", ", t AS (SELECT stem, min(name) FILTER (tag = 'A') AS a_name, (stem::BIGINT + 1) || '_A.npy' AS b_name FROM manifest GROUP BY stem) SELECT stem, a_name, b_name FROM t LEFT JOIN quality q ON q.name = a_name LEFT JOIN quality p ON p.name = b_name WHERE coalesce(q.valid_ratio, 0) >= 0.5 AND coalesce(p.valid_ratio, 0) >= 0.5")(
    lambda m, q: MF.both_good(m.groupBy("stem").agg(F.min(F.when(F.col("tag") == "A", F.col("name"))).alias("a_name")).withColumn("b_name", F.concat((F.col("stem").cast("long") + 1).cast("string"), F.lit("_A.npy"))), q, 0.5).select("stem", "a_name", "b_name")
)
query("missing_files", "manifest", ", i AS (SELECT stem, split, unnest(['A', 'B', 'label']) AS tag FROM (SELECT DISTINCT stem, split FROM manifest)), e AS (SELECT stem, tag, split || '/' || tag || '/' || stem || '_' || tag || '.npy' AS path FROM i) SELECT e.* FROM e ANTI JOIN manifest m ON m.path = e.path")(
    lambda m: m.select("stem", "split").distinct().select("stem", F.explode(F.array(*map(F.lit, MF.TAGS))).alias("tag"), "split").select("stem", "tag", F.concat("split", F.lit("/"), "tag", F.lit("/"), "stem", F.lit("_"), "tag", F.lit(".npy")).alias("path")).join(m.select("path"), "path", "left_anti").select("stem", "tag", "path")
)
query("labeled_only", "manifest", "SELECT stem, path FROM manifest m WHERE tag = 'A' AND EXISTS (SELECT 1 FROM manifest l WHERE l.tag = 'label' AND l.stem = m.stem)")(lambda m: m.where("tag = 'A'").join(m.where("tag = 'label'").select("stem"), "stem", "left_semi").select("stem", "path"))
_NAMES = ", p AS (SELECT stem || CASE WHEN stem::BIGINT % 3 = 0 THEN '_prob' WHEN stem::BIGINT % 3 = 1 THEN '_cls' ELSE '' END AS name FROM manifest WHERE tag = 'B'), g AS (SELECT stem || CASE WHEN stem::BIGINT % 2 = 0 THEN '_gt' ELSE '_x' END AS name FROM manifest WHERE tag = 'label')"


@query("pred_gt_match", "manifest", _NAMES + """, pn AS (SELECT name, regexp_replace(name, '_(probmap|probs|prob|cls|pred|mask|gt)$', '') AS base FROM p), gn AS (SELECT name, regexp_replace(name, '_(probmap|probs|prob|cls|pred|mask|gt)$', '') AS base FROM g)
SELECT pn.name AS pred, coalesce(a.name, b.name) AS gt FROM pn LEFT JOIN gn a ON a.base = pn.base LEFT JOIN gn b ON b.name = pn.name || '_x' WHERE coalesce(a.name, b.name) IS NOT NULL""")
def pred_gt_match(m):
    k = F.col("stem").cast("long")
    pred = m.where("tag = 'B'").select(F.concat("stem", F.when(k % 3 == 0, "_prob").when(k % 3 == 1, "_cls").otherwise("")).alias("pred")).withColumn("base", S.basename(F.col("pred")))
    gt = m.where("tag = 'label'").select(F.concat("stem", F.when(k % 2 == 0, "_gt").otherwise("_x")).alias("gt")).withColumn("base", S.basename(F.col("gt")))
    raw = gt.select(F.col("gt").alias("raw"), F.regexp_replace("gt", "_x$", "").alias("pred_raw")).where(F.col("raw").endswith("_x"))
    both = pred.join(gt, "base", "left").join(raw, F.col("pred") == F.col("pred_raw"), "left")
    return both.select("pred", F.coalesce("gt", "raw").alias("gt")).where("gt IS NOT NULL")


query("pred_fallback", "manifest", "SELECT s.stem, coalesce(c.path, t.path) AS path FROM (SELECT DISTINCT stem FROM manifest) s LEFT JOIN (SELECT * FROM manifest WHERE tag = 'B') c USING (stem) LEFT JOIN (SELECT * FROM manifest WHERE tag = 'label') t ON t.stem = s.stem WHERE coalesce(c.path, t.path) IS NOT NULL")(
    lambda m: m.groupBy("stem").agg(F.coalesce(F.min(F.when(F.col("tag") == "B", F.col("path"))), F.min(F.when(F.col("tag") == "label", F.col("path")))).alias("path")).where("path IS NOT NULL")
)
query("chip_georef", "manifest", ", o AS (SELECT DISTINCT 'scene_' || (stem::BIGINT % 10) || '_' || (stem::BIGINT % 7 * 64) || '_' || (stem::BIGINT % 5 * 64) AS name FROM manifest), r AS (SELECT 'scene_' || i AS stem, 10.0::DOUBLE AS res, i * 1000.0::DOUBLE AS x0, 5000.0::DOUBLE + i AS y0 FROM range(8) t(i)), p AS (SELECT name, regexp_extract(name, '^(.+)_(\\d+)_(\\d+)$', 1) AS stem, regexp_extract(name, '^(.+)_(\\d+)_(\\d+)$', 2)::BIGINT AS y, regexp_extract(name, '^(.+)_(\\d+)_(\\d+)$', 3)::BIGINT AS x FROM o) SELECT name, x0 + x * res AS xmin, x0 + (x + 64) * res AS xmax, y0 - (y + 64) * res AS ymin, y0 - y * res AS ymax FROM p JOIN r USING (stem)")(
    lambda m: _georef(m)
)


def _georef(m):
    k = F.col("stem").cast("long")
    names = m.select(F.concat(F.lit("scene_"), k % 10, F.lit("_"), k % 7 * 64, F.lit("_"), k % 5 * 64).alias("name")).distinct()
    base, y, x = S.tile_offset(F.col("name"))
    i = F.col("id")
    rasters = m.sparkSession.range(8).select(F.concat(F.lit("scene_"), i).alias("stem"), F.lit(10.0).alias("res"), (i * 1000.0).alias("x0"), (5000.0 + i).alias("y0"))
    at = names.select("name", base.alias("stem"), y.alias("y"), x.alias("x")).join(F.broadcast(rasters), "stem")
    edge = lambda o, c, k, sign: F.col(o) + sign * (F.col(c) + k) * F.col("res")
    return at.select("name", edge("x0", "x", 0, 1).alias("xmin"), edge("x0", "x", 64, 1).alias("xmax"), edge("y0", "y", 64, -1).alias("ymin"), edge("y0", "y", 0, -1).alias("ymax"))


query("scan_split_list", "manifest", "SELECT name, path FROM manifest WHERE stem::BIGINT % 17 = 0")(lambda m: _listed(m).select("name", "path"))
query("intersect_names", "manifest", "SELECT stem FROM manifest WHERE tag = 'A' INTERSECT SELECT stem FROM manifest WHERE tag = 'B' INTERSECT SELECT stem FROM manifest WHERE tag = 'label'")(lambda m: m.where("tag = 'A'").select("stem").intersect(m.where("tag = 'B'").select("stem")).intersect(m.where("tag = 'label'").select("stem")))
query("union_tiles", "manifest quality", "SELECT name, path, NULL::DOUBLE AS valid_ratio FROM manifest WHERE tag = 'A' UNION ALL SELECT name, NULL, valid_ratio FROM quality")(lambda m, q: m.where("tag = 'A'").select("name", "path").unionByName(q.select("name", "valid_ratio"), allowMissingColumns=True))
query("distinct_values", "px", "SELECT DISTINCT gt AS value FROM px ORDER BY value")(lambda px: px.select(F.col("gt").alias("value")).distinct().orderBy("value"))
query("except_values", "cls_px", "SELECT label AS value FROM cls_px EXCEPT SELECT * FROM (VALUES (0), (1), (255)) ORDER BY value")(lambda px: px.select(F.col("label").alias("value")).distinct().exceptAll(px.sparkSession.sql("SELECT * FROM VALUES (0), (1), (255) AS t(value)")))
query("topk_examples", "px", "SELECT scene_id, r, c, prob FROM px WHERE gt = 1 ORDER BY prob DESC, scene_id, r, c LIMIT 10")(lambda px: px.where("gt = 1").select("scene_id", "r", "c", "prob").orderBy(F.col("prob").desc(), "scene_id", "r", "c").limit(10))
query("filter_split", "chips", "SELECT chip_id, split FROM chips WHERE split = 'val'")(lambda c: c.where("split = 'val'").select("chip_id", "split"))
query("lookup_chip", "chips", "SELECT chip_id, split, round(t0[1], 6) AS first FROM chips WHERE chip_id = 7 LIMIT 1")(lambda c: MF.lookup(c, "chip_id", 7).select("chip_id", "split", F.round(F.col("t0")[0], 6).alias("first")))
query("scan_index", "chips", "SELECT chip_id, split, len(t0) AS n FROM chips")(lambda c: _index(c, "index", "chip_id", "split", "t0").select("chip_id", "split", F.size("t0").cast("long").alias("n")))
query("scan_summary_csv", "quality", "SELECT name, valid_ratio, finite_count FROM quality")(_summary)
query("chip_quarantine", "quality", "SELECT name, valid_ratio, CASE WHEN valid_ratio < 0.5 OR finite_count = 0 THEN 'bad' ELSE 'good' END AS verdict FROM quality")(lambda q: _quarantine(q))


def _quarantine(q):
    """Good and bad files in a table each, by the summary."""
    good, bad = _new(q.sparkSession, "good"), _new(q.sparkSession, "bad")
    W.quarantine(q, (F.col("valid_ratio") < 0.5) | (F.col("finite_count") == 0), good, bad)
    both = [R.read_index(q.sparkSession, path, "name", "valid_ratio").withColumn("verdict", F.lit(v)) for path, v in ((good, "good"), (bad, "bad"))]
    return both[0].unionByName(both[1])


# --- strings ---------------------------------------------------------------------------------------------------------
query("str_prefix", "manifest", "SELECT path, regexp_replace(stem || '_' || tag, '_(A|B|OUT|LABEL|label|mask)$', '') AS prefix FROM manifest")(lambda m: m.select("path", S.prefix(S.stem(F.col("path"))).alias("prefix")))
query("str_basename", "manifest", _NAMES + "SELECT name, regexp_replace(name, '_(probmap|probs|prob|cls|pred|mask|gt)$', '') AS base FROM p")(lambda m: m.where("tag = 'B'").select(F.concat("stem", F.when(F.col("stem").cast("long") % 3 == 0, "_prob").when(F.col("stem").cast("long") % 3 == 1, "_cls").otherwise("")).alias("name")).withColumn("base", S.basename(F.col("name"))))
query("str_stem_parts", "manifest", "SELECT path, stem || '_' || tag AS file_stem, '.npy' AS ext, tag AS parent FROM manifest")(lambda m: m.select("path", S.stem(F.col("path")).alias("file_stem"), S.extension(F.col("path")).alias("ext"), S.parent(F.col("path")).alias("parent")))
query("str_outname", "manifest", "SELECT stem, stem || '_th0.30_ma' || (stem::BIGINT % 50) || '.png' AS name FROM manifest WHERE tag = 'A'")(lambda m: m.where("tag = 'A'").select("stem", F.format_string("%s_th%.2f_ma%d.png", "stem", F.lit(0.3), F.col("stem").cast("long") % 50).alias("name")))
query("path_resolve", "manifest", "SELECT path, '/data/' || path AS resolved FROM manifest")(lambda m: m.select("path", S.resolve(F.lit("/data/"), F.translate("path", "/", "\\")).alias("resolved")))

# --- splits ----------------------------------------------------------------------------------------------------------
_KEY = "md5('42:' || stem)"
query("split_ranked", "manifest", f", f AS (SELECT DISTINCT stem FROM manifest), k AS (SELECT stem, row_number() OVER (ORDER BY {_KEY}, stem) AS k, count(*) OVER () AS n FROM f) SELECT stem, CASE WHEN k <= round(n * 0.2) THEN 'val' WHEN k <= round(n * 0.2) + round(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM k")(lambda m: SP.ranked(m.select("stem").distinct(), "stem", 0.2, 0.1))
query("split_hash", "manifest", f"SELECT DISTINCT stem, {split_sql('stem')} AS split FROM manifest")(lambda m: m.select("stem").distinct().select("stem", split_of(F.col("stem")).alias("split")))
query("split_bernoulli", "px", ", u AS (SELECT DISTINCT scene_id, ('0x' || substr(md5('42:' || scene_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM px) SELECT scene_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM u")(lambda px: px.select("scene_id").distinct().select("scene_id", SP.bernoulli(F.col("scene_id"), 0.7, 0.15).alias("split")))


@query("ensure_val", "manifest", f", f AS (SELECT DISTINCT stem FROM manifest WHERE split = 'train'), k AS (SELECT stem, row_number() OVER (ORDER BY {_KEY}, stem) AS k, count(*) OVER () AS n FROM f) SELECT stem, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM k")
def ensure_val(m):
    """A table without val rows gets some; one that has them stays as it is."""
    rows = m.where("split = 'train'").select("stem", "split").distinct()
    has = rows.agg(F.coalesce(F.max((F.col("split") == "val").cast("int")), F.lit(0)).alias("_has"))
    made = SP.ranked(rows.drop("split"), "stem", 0.1, 0.0, "least1").withColumnRenamed("split", "made")
    return rows.join(made, "stem").crossJoin(F.broadcast(has)).select("stem", F.when(F.col("_has") == 1, F.col("split")).otherwise(F.col("made")).alias("split"))


query("stratified_val", "manifest", f", f AS (SELECT DISTINCT stem, split, stem::BIGINT % 4 = 0 AS pos FROM manifest), k AS (SELECT *, row_number() OVER (PARTITION BY pos, split = 'train' ORDER BY {_KEY}, stem) AS k FROM f) SELECT stem, pos, CASE WHEN split = 'train' AND k <= 50 THEN 'val' ELSE split END AS split FROM k")(
    lambda m: SP.stratified(m.select("stem", "split", (F.col("stem").cast("long") % 4 == 0).alias("pos")).distinct(), "stem", F.col("pos"), 50)
)
query("group_move_first", "px", ", m AS (SELECT min(scene_id) AS s FROM px) SELECT DISTINCT scene_id, CASE WHEN scene_id = s THEN 'val' ELSE 'train' END AS split FROM px, m")(lambda px: px.select("scene_id").distinct().crossJoin(F.broadcast(px.agg(F.min("scene_id").alias("s")))).select("scene_id", F.when(F.col("scene_id") == F.col("s"), "val").otherwise("train").alias("split")))


@query("oversample_weights", "px", ", w AS (SELECT scene_id, CASE WHEN bool_or(gt = 1 AND prob >= 1.0) THEN 3 ELSE 1 END AS w FROM px GROUP BY scene_id), c AS (SELECT *, sum(w) OVER (ORDER BY scene_id) - w AS lo, sum(w) OVER (ORDER BY scene_id) AS hi, sum(w) OVER () AS t FROM w), d AS (SELECT i AS draw, ('0x' || substr(md5('42:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(100) r(i)) SELECT draw, scene_id, w FROM d JOIN c ON u * t >= lo AND u * t < hi")
def oversample_weights(px):
    """A hundred seeded draws with replacement, each scene weighted."""
    w = px.groupBy("scene_id").agg(F.when(F.bool_or((F.col("gt") == 1) & (F.col("prob") >= 1.0)), 3).otherwise(1).alias("w"))
    return SP.weighted_draws(w, "scene_id", "w", 100)


query("shuffle_rows", "manifest", f"SELECT stem FROM (SELECT DISTINCT stem FROM manifest) ORDER BY {_KEY}, stem LIMIT 100")(lambda m: m.select("stem").distinct().orderBy(SP.shuffle_key(F.col("stem")), "stem").limit(100))

# --- scene catalogue -------------------------------------------------------------------------------------------------
_FIRST = ", k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE source_endpoint WHEN 'aws' THEN 0 ELSE 1 END, datetime, event_id) AS k FROM scene_items)"
SEARCH = "datetime >= TIMESTAMP '2024-01-05 00:00:00' AND datetime <= TIMESTAMP '2024-01-20 23:59:59' AND cloud < 30 AND collection IN ('click', 'view', 'purchase')"
_NOTCHED = "((xmin <= 50000 AND xmax >= 30000 AND ymin <= 34000 AND ymax >= 30000) OR (xmin <= 34000 AND xmax >= 30000 AND ymin <= 50000 AND ymax >= 30000))"
query("scene_search", "scene_items aoi", f"SELECT id, event_id, cloud FROM scene_items s JOIN aoi a ON a.aoi_id = s.aoi_id % 25 WHERE {SEARCH} AND {_NOTCHED}")(lambda i, a: _search(i, a))


def _search(items, aoi):
    """Items with the outline of their AOI as footprint, searched by time, cloud, collection and an area with a notch: an L
    that some footprints meet by their boxes only."""
    corners = [(30000, 30000), (50000, 30000), (50000, 34000), (34000, 34000), (34000, 50000), (30000, 50000), (30000, 30000)]
    area = items.sparkSession.range(1).select(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in corners]).alias("ring"))
    rings = aoi.select(F.col("aoi_id").alias("k"), G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("ring"))
    placed = items.withColumn("k", F.col("aoi_id") % 25).join(rings, "k")
    return SC.search(placed, "2024-01-05 00:00:00", "2024-01-20 23:59:59", 30, ["click", "view", "purchase"], area, "event_id", 20000.0).select("id", "event_id", "cloud")


query("source_exclusion", "scene_items", "SELECT event_id, source_endpoint, collection FROM scene_items WHERE NOT (source_endpoint = 'usgs' AND collection = 'click') AND NOT (source_endpoint = 'aws' AND collection = 'error')")(
    lambda i: i.join(F.broadcast(i.sparkSession.sql("SELECT * FROM VALUES ('usgs', 'click'), ('aws', 'error') AS x(source_endpoint, collection)")), ["source_endpoint", "collection"], "left_anti").select("event_id", "source_endpoint", "collection")
)
query("dedupe_items", "scene_items", _FIRST + "SELECT id, event_id, source_endpoint FROM k WHERE k = 1")(lambda i: MF.first_of(i, ["id"], F.when(F.col("source_endpoint") == "aws", 0).otherwise(1), F.col("datetime"), F.col("event_id")).select("id", "event_id", "source_endpoint"))
query("sort_sources", "scene_items", "SELECT source_endpoint, count(*) AS n, CASE source_endpoint WHEN 'aws' THEN 0 ELSE 1 END AS priority FROM scene_items GROUP BY ALL ORDER BY priority")(lambda i: i.groupBy("source_endpoint").agg(F.count("*").alias("n")).withColumn("priority", F.when(F.col("source_endpoint") == "aws", 0).otherwise(1)).orderBy("priority"))
query("date_window", "scene_items", "SELECT event_id, CAST(CAST(datetime AS DATE) - 7 AS VARCHAR) AS lo, CAST(CAST(datetime AS DATE) + 7 AS VARCHAR) || ' 23:59:59' AS hi FROM scene_items")(lambda i: i.select("event_id", F.date_add(F.to_date("datetime"), -7).cast("string").alias("lo"), F.concat(F.date_add(F.to_date("datetime"), 7).cast("string"), F.lit(" 23:59:59")).alias("hi")))
query("json_props", "scene_items", "SELECT event_id, coalesce((props::JSON ->> 'k')::BIGINT, -1) AS k, coalesce(props::JSON ->> 'missing', 'none') AS other FROM scene_items")(lambda i: i.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other")))
query("asset_lowercase", "scene_items", "SELECT event_id, 's3://' || lower(collection) || '/' || event_id AS href FROM scene_items")(
    lambda i: i.select("event_id", F.transform_keys(F.create_map(F.upper("collection"), F.struct(F.concat(F.lit("s3://"), "collection", F.lit("/"), F.col("event_id").cast("string")).alias("href"))), lambda k, v: F.lower(k)).alias("assets"), F.lower("collection").alias("k")).select("event_id", F.expr("assets[k].href").alias("href"))
)


@query("scene_pair", "scene_items", """, t AS (SELECT * FROM (VALUES ('t0', DATE '2024-01-08'), ('t1', DATE '2024-01-23')) AS v(which, target)),
n AS (SELECT s.*, t.which, row_number() OVER (PARTITION BY aoi_id, which ORDER BY cloud, abs(date_diff('day', target, CAST(datetime AS DATE))), id, event_id) AS k FROM scene_items s JOIN t ON CAST(datetime AS DATE) BETWEEN target - 7 AND target + 7 WHERE cloud < 30)
SELECT a.aoi_id, a.event_id AS t0_event, b.event_id AS t1_event FROM n a JOIN n b ON a.aoi_id = b.aoi_id WHERE a.which = 't0' AND b.which = 't1' AND a.k = 1 AND b.k = 1""")
def scene_pair(items):
    return SC.pair(items, {"t0": "2024-01-08", "t1": "2024-01-23"}).select("aoi_id", F.col("t0").alias("t0_event"), F.col("t1").alias("t1_event"))


query("months_between_ym", "scene_items", "SELECT event_id, ((year(datetime) - 2023) * 12 + month(datetime) - 5)::BIGINT AS months FROM scene_items")(lambda i: i.select("event_id", SC.months_apart(F.lit("2023-05-01").cast("date"), "datetime").cast("long").alias("months")))
query("aoi_detections", "aoi detections", "SELECT d.id, d.aoi_id, a.name FROM detections d JOIN aoi a USING (aoi_id)")(lambda a, d: d.join(a.select("aoi_id", "name"), "aoi_id").select("id", "aoi_id", "name"))
query("upsert_detections", "aoi detections", "SELECT DISTINCT id, aoi_id, round(score, 4) AS score FROM detections WHERE aoi_id IN (SELECT aoi_id FROM aoi)")(lambda a, d: _upserted(a, d))


def _upserted(a, d):
    """Detections of known AOIs appended to a table in two overlapping batches; an id that it holds is not added again."""
    path = _new(d.sparkSession, "detections")
    known = d.join(a.select("aoi_id"), "aoi_id", "left_semi").select("id", "aoi_id", "score")
    for batch in (known.where("id % 3 <> 0"), known.where("id % 3 <> 1")):
        W.append_new(batch, path, "id")
    return R.read_index(d.sparkSession, path, "id", "aoi_id", "score").withColumn("score", F.round("score", 4))


query("scan_detections", "detections", "SELECT id, aoi_id, round(score, 4) AS score FROM detections")(lambda d: _index(d, "detections", "id", "aoi_id", "score").select("id", "aoi_id", F.round("score", 4).alias("score")))

# --- training history ------------------------------------------------------------------------------------------------
_RUN = "PARTITION BY run ORDER BY epoch"


def by_run():
    return Window.partitionBy("run").orderBy("epoch")


def before():
    return by_run().rowsBetween(Window.unboundedPreceding, -1)


query("running_best", "history", f"SELECT run, epoch, val_loss, min(val_loss) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, coalesce(val_loss < min(val_loss) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM history")(
    lambda h: h.select("run", "epoch", "val_loss", F.min("val_loss").over(before()).alias("best")).withColumn("improved", F.coalesce(F.col("val_loss") < F.col("best"), F.lit(True)))
)
query("early_stop", "history", f", i AS (SELECT *, coalesce(val_loss < min(val_loss) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM history), l AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER ({_RUN}) AS last FROM i) SELECT run, min(epoch) AS stop_epoch FROM l WHERE epoch - last >= 10 GROUP BY run")(
    lambda h: h.withColumn("better", F.coalesce(F.col("val_loss") < F.min("val_loss").over(before()), F.lit(True))).withColumn("last", F.max(F.when(F.col("better"), F.col("epoch"))).over(by_run())).where("epoch - last >= 10").groupBy("run").agg(F.min("epoch").alias("stop_epoch"))
)
query("best_epoch", "history", "SELECT run, epoch AS best_epoch, f1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS k FROM history) WHERE k = 1")(lambda h: MF.first_of(h, ["run"], F.col("f1").desc(), F.col("epoch")).select("run", F.col("epoch").alias("best_epoch"), "f1"))
query("lr_changes", "history", f"SELECT run, epoch, round(lr, 9) AS lr FROM (SELECT *, lag(lr) OVER ({_RUN}) AS prior FROM history) WHERE lr <> prior")(lambda h: h.withColumn("prior", F.lag("lr").over(by_run())).where("lr <> prior").select("run", "epoch", F.round("lr", 9).alias("lr")))
query("running_meter", "history", f"SELECT run, epoch, round(avg(val_loss) OVER ({_RUN}), 6) AS mean, round(stddev_samp(val_loss) OVER ({_RUN}), 6) AS std FROM history")(lambda h: h.select("run", "epoch", F.round(F.avg("val_loss").over(by_run()), 6).alias("mean"), F.round(F.stddev_samp("val_loss").over(by_run()), 6).alias("std")))
query("color_dictionary", "cls_px", ", c AS (SELECT DISTINCT pred * 60 AS r, label AS g, (pred + label) % 7 AS b FROM cls_px) SELECT r, g, b, row_number() OVER (ORDER BY r, g, b) - 1 AS id FROM c")(lambda px: _colors(px))
query("color_encode", "cls_px", ", c AS (SELECT DISTINCT pred * 60 AS r, label AS g, (pred + label) % 7 AS b FROM cls_px WHERE label < 255), d AS (SELECT *, row_number() OVER (ORDER BY r, g, b) - 1 AS id FROM c) SELECT p.scene_id, p.r, p.c, coalesce(d.id, 0) AS id FROM cls_px p LEFT JOIN d ON d.r = p.pred * 60 AND d.g = p.label AND d.b = (p.pred + p.label) % 7")(lambda px: _encode(px))


def _rgb():
    return [(F.col("pred") * 60).alias("cr"), F.col("label").alias("cg"), ((F.col("pred") + F.col("label")) % 7).alias("cb")]


def _colors(px):
    """Distinct colours are few (a palette), so one task may number them."""
    return px.select(*_rgb()).distinct().select(F.col("cr").alias("r"), F.col("cg").alias("g"), F.col("cb").alias("b"), (F.row_number().over(Window.orderBy("cr", "cg", "cb")) - 1).cast("long").alias("id"))


def _encode(px):
    palette = _colors(px.where("label < 255")).select(F.col("r").alias("cr"), F.col("g").alias("cg"), F.col("b").alias("cb"), "id")
    return px.select("scene_id", "r", "c", *_rgb()).join(palette, ["cr", "cg", "cb"], "left").select("scene_id", "r", "c", F.coalesce("id", F.lit(0)).alias("id"))
