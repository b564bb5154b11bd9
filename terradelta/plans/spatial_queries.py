"""Queries on vector features, spatial joins and zonal statistics.

Scenes lie on a 100 km square: scene s has its lower left corner at ((s % 10) * 10 km, (s // 10 % 10) * 10 km), pixels of
100 m; row 0 is the northernmost.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terradelta.functions import geometry as G
from terradelta.operators import alerts as AL
from terradelta.operators import components as CC
from terradelta.operators import polygons as PG
from terradelta.operators import scenes as SC
from terradelta.operators import spatial as SJ
from terradelta.plans.registry import query

_MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
DIST2 = G.segment_box_distance2()
ROAD_BUFFER = 6.0


def _roads(r):
    return r.select("road_id", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"))


def near_roads(a, roads, buffer=ROAD_BUFFER):
    """The boxes with a road near by."""
    return SJ.met(a, _roads(roads), buffer=buffer, exact=f"{DIST2} <= {buffer * buffer}", more=("x1", "y1", "x2", "y2"))


query("sj_exists", "alerts zones", f"SELECT alert_id, EXISTS (SELECT 1 FROM zones b WHERE {_MEET}) AS in_restricted_zone FROM alerts a")(lambda a, z: SJ.flag(a, SJ.box_pairs(a, z, "alert_id", "zone_id"), "alert_id", "in_restricted_zone").select("alert_id", "in_restricted_zone"))
query("sj_overlay_flags", "alerts buildings roads", f"SELECT alert_id, EXISTS (SELECT 1 FROM buildings b WHERE {_MEET}) AS overlaps_building, EXISTS (SELECT 1 FROM roads WHERE {DIST2} <= 36) AS overlaps_road FROM alerts a")(
    lambda a, b, r: SJ.flag_met(SJ.flag_met(a, SJ.met(a, b), "overlaps_building"), near_roads(a, r), "overlaps_road").select("alert_id", "overlaps_building", "overlaps_road")
)
query("sj_count", "aoi buildings", f"SELECT a.aoi_id, count(b.bld_id) AS n FROM aoi a LEFT JOIN buildings b ON {_MEET} GROUP BY a.aoi_id")(lambda a, b: SJ.count(a, SJ.box_pairs(a, b, "aoi_id", "bld_id", cell=20000.0), "aoi_id", "n").select("aoi_id", "n"))
@query("sj_clip", "alerts zones", f"SELECT alert_id, zone_id, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax, round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)), 3) AS area FROM alerts a JOIN zones b ON {_MEET}")
def sj_clip(alerts, zones):
    """Outlines of alerts cut to the zones that they meet."""
    met = SJ.box_pairs(alerts, zones, "alert_id", "zone_id")
    cut = G.clipped(_ring(), *[F.col(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    return met.select("alert_id", "zone_id", cut.alias("b")).select("alert_id", "zone_id", "b.xmin", "b.ymin", "b.xmax", "b.ymax", F.round("b.area", 3).alias("area"))


_L_MEET = "b.xmin <= a.xmax AND b.xmax >= a.xmin AND b.ymin <= a.ymin + a.h / 2 AND b.ymax >= a.ymin OR b.xmin <= a.xmin + a.w / 2 AND b.xmax >= a.xmin AND b.ymin <= a.ymax AND b.ymax >= a.ymin"


@query("aoi_scene_join", "aoi alerts", f"SELECT a.aoi_id, b.alert_id AS scene FROM aoi a JOIN alerts b ON {_L_MEET}")
def aoi_scene_join(aoi, scenes):
    """Footprints and the AOIs, L-shaped here, that they meet: boxes first, then rings."""
    x, y, w, h, X, Y = (F.col(c) for c in ("xmin", "ymin", "w", "h", "xmax", "ymax"))
    corners = [(x, y), (X, y), (X, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, Y), (x, Y), (x, y)]
    areas = aoi.withColumn("area", F.array(*[G.point(a, b) for a, b in corners]))
    met = SJ.box_pairs(scenes.withColumn("ring", _ring()), areas, "alert_id", "aoi_id", cell=20000.0, more=("area",))
    return met.where(G.rings_meet(F.col("ring"), F.col("area"))).select("aoi_id", F.col("alert_id").alias("scene"))


#: Where the square lies in UTM zone 43 north, for footprints in WGS84.
EAST, NORTH, CRS = 300000.0, 2000000.0, "EPSG:32643"
LON0, LAT0 = G.to_wgs84(f"({EAST}D + x)", f"({NORTH}D + y)", "32643")
_BOXES = ", rc AS (SELECT scene_id, (scene_id % 10) * 10000.0::DOUBLE + min(c) * 100 AS xmin, (scene_id // 10 % 10) * 10000.0::DOUBLE + (63 - max(r)) * 100 AS ymin, (scene_id % 10) * 10000.0::DOUBLE + (max(c) + 1) * 100 AS xmax, (scene_id // 10 % 10) * 10000.0::DOUBLE + (64 - min(r)) * 100 AS ymax FROM px GROUP BY scene_id)"
_CATALOG = _BOXES + f", co AS (SELECT scene_id, x, y FROM (SELECT scene_id, unnest([xmin, xmax]) AS x, ymin, ymax FROM rc), LATERAL (SELECT unnest([ymin, ymax]) AS y)), ll AS (SELECT scene_id, {LON0} AS lon, {LAT0} AS lat FROM co)".replace("0D + ", "0::DOUBLE + ")


def _origin():
    s = F.col("scene_id")
    return (s % 10) * 10000.0, F.expr("scene_id div 10 % 10") * 10000.0


def raster_catalog(px):
    """Footprint of each scene's pixels, its crs and its box in WGS84; an error if there is no scene at all."""
    x, y = _origin()
    return SJ.footprints(px, ["scene_id"], x, y + 6400, 100.0, CRS, LON0, LAT0)


query("raster_catalog", "px", _CATALOG + f"SELECT rc.*, '{CRS}' AS crs, w.* EXCLUDE (scene_id) FROM rc JOIN (SELECT scene_id, round(min(lon), 6) AS lon0, round(min(lat), 6) AS lat0, round(max(lon), 6) AS lon1, round(max(lat), 6) AS lat1 FROM ll GROUP BY scene_id) w USING (scene_id)")(
    lambda px: raster_catalog(px).select("scene_id", "crs", "xmin", "ymin", "xmax", "ymax", *[F.round(c, 6).alias(c) for c in ("lon0", "lat0", "lon1", "lat1")])
)
query("sj_raster_footprint", "zones px", _BOXES + f"SELECT zone_id, scene_id FROM zones a JOIN rc b ON {_MEET}")(lambda z, px: SJ.box_pairs(z, raster_catalog(px), "zone_id", "scene_id", cell=5000.0).select("zone_id", "scene_id"))

# --- zones as polygons: a notched outline, a hole in it, and a second part beside it ------------------------------------
#: Corners of the rings as shares of the zone's box, moved by SHIFT so that no pixel's centre lies on an edge.
RINGS = [[(0.0, 0.0), (1.0, 0.1), (0.9, 1.0), (0.5, 0.45), (0.05, 0.9)], [(0.3, 0.15), (0.6, 0.12), (0.45, 0.35)], [(1.1, 0.2), (1.4, 0.25), (1.2, 0.6)]]
SHIFT = 7.3
_SIDES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
_PIX = f""", g AS (SELECT *, (scene_id % 10) * 10000 + c * 100 + 50.0::DOUBLE AS x, (scene_id // 10 % 10) * 10000 + (63 - r) * 100 + 50.0::DOUBLE AS y FROM {{t}}),
e AS (SELECT zone_id, xmin, xmin + fx1::DOUBLE * w + {SHIFT}::DOUBLE AS x1, ymin + fy1::DOUBLE * h + {SHIFT}::DOUBLE AS y1, xmin + fx2::DOUBLE * w + {SHIFT}::DOUBLE AS x2, ymin + fy2::DOUBLE * h + {SHIFT}::DOUBLE AS y2
      FROM zones, (VALUES {_SIDES}) AS v(fx1, fy1, fx2, fy2)),
zp AS (SELECT zone_id, scene_id, r, c FROM e JOIN g ON x >= xmin AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def zone_polygons(zones):
    corner = lambda f: G.point(F.col("xmin") + f[0] * F.col("w") + SHIFT, F.col("ymin") + f[1] * F.col("h") + SHIFT)
    return zones.select("zone_id", F.array(*[F.array(*[corner(f) for f in [*ring, ring[0]]]) for ring in RINGS]).alias("rings"))


def scenes(px):
    """Place and extent of the scenes' grids."""
    x, y = _origin()
    return px.select("scene_id").distinct().select("scene_id", x.alias("x0"), (y + 6400).alias("y1"), F.lit(100.0).alias("res"), F.lit(64).alias("height"), F.lit(64).alias("width"))


_ZM = _PIX.format(t="px") + ", m AS (SELECT zone_id, scene_id, avg(prob) AS m FROM zp JOIN px USING (scene_id, r, c) GROUP BY ALL), zm AS (SELECT zone_id, avg(m) AS mean_prob, count(*) AS hits FROM m GROUP BY zone_id)"


def zonal_mean(zones, px):
    """Mean over scenes of each scene's mean probability in a polygon, and the number of scenes."""
    sums = {"s": F.col("prob"), "n": F.lit(1)}
    members, shapes = PG.shapes(zone_polygons(zones), "zone_id")
    per = PG.zonal(shapes, px.where("NOT isnan(prob)"), scenes(px), "_shape", ["scene_id"], sums)
    found = per.groupBy("_shape").agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("mean_prob"), F.count("*").alias("hits"))
    return zones.select("zone_id").join(members.join(found, "_shape"), "zone_id", "left").select("zone_id", "mean_prob", F.coalesce("hits", F.lit(0)).alias("hits"))


query("zonal_mean", "zones px", _ZM + "SELECT z.zone_id, round(mean_prob, 6) AS mean_prob, coalesce(hits, 0) AS hits FROM zones z LEFT JOIN zm USING (zone_id)")(zonal_mean)
_ZH = _PIX.format(t="land_cover") + ", h AS (SELECT zone_id, code, count(*) AS n FROM zp JOIN land_cover USING (scene_id, r, c) WHERE code <> 0 GROUP BY ALL)"


def zone_classes(zones, cover):
    """(zone_id, code, n) of the pixels with data in each polygon."""
    members, shapes = PG.shapes(zone_polygons(zones), "zone_id")
    counts = PG.zonal(shapes, cover.where("code <> 0"), scenes(cover), "_shape", ["scene_id"], {"n": F.lit(1)}, ["code"], stacked=True)
    return members.join(counts, "_shape").select("zone_id", "code", "n")


query("zonal_hist", "zones land_cover", _ZH + "SELECT zone_id, '{' || string_agg('\"' || code || '\":' || n, ',' ORDER BY code) || '}' AS hist FROM h GROUP BY zone_id")(
    lambda z, lc: zone_classes(z, lc).groupBy("zone_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n"))))).alias("hist"))
)
query("map_hist", "zones land_cover", _ZH + "SELECT zone_id, coalesce(sum(n) FILTER (code = 40), 0)::BIGINT AS cropland, count(*) AS classes FROM h GROUP BY zone_id")(
    lambda z, lc: zone_classes(z, lc).groupBy("zone_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m")).select("zone_id", F.coalesce(F.element_at("m", 40), F.lit(0)).alias("cropland"), F.size("m").cast("long").alias("classes"))
)
#: Land-cover classes and groups (fixed values of the land-cover product and of the rules).
NAMES = {10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare / sparse", 70: "Snow / ice", 80: "Water", 90: "Herbaceous wetland", 95: "Mangroves", 100: "Moss / lichen"}
GROUPS = {"BUILT": (50,), "VEG": (10, 20, 30), "WET": (90, 95), "WATER": (80,), "AGRI": (40,), "BARE": (60,)}
_F = _ZH + ", f AS (SELECT z.zone_id, " + ", ".join(f"coalesce(sum(n) FILTER (code IN ({', '.join(map(str, codes))}))::DOUBLE / sum(n), 0) AS f_{g.lower()}" for g, codes in GROUPS.items()) + " FROM zones z LEFT JOIN h USING (zone_id) GROUP BY z.zone_id)"


def fractions(zones, cover):
    """Share of each land-cover group in a polygon, 0 where it has no data; snow and moss are in no group."""
    total = F.sum("n")
    share = lambda g: F.coalesce(F.sum(F.when(F.col("code").isin(*GROUPS[g]), F.col("n"))) / total, F.lit(0.0)).alias(f"f_{g.lower()}")
    return zones.select("zone_id").join(zone_classes(zones, cover), "zone_id", "left").groupBy("zone_id").agg(*map(share, GROUPS))


query("zonal_fractions", "zones land_cover", _F + "SELECT zone_id, " + ", ".join(f"round(f_{g.lower()}, 6) AS f_{g.lower()}" for g in GROUPS) + " FROM f")(lambda z, lc: fractions(z, lc).select("zone_id", *[F.round(f"f_{g.lower()}", 6).alias(f"f_{g.lower()}") for g in GROUPS]))
_NAME_SQL = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " END"
_DOM = _F + f", d AS (SELECT zone_id, code, {_NAME_SQL} AS name FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, code) AS k FROM h) WHERE k = 1)"


def dominant(zones, cover):
    """Most frequent class of each polygon; ties go to the lowest code."""
    top = zone_classes(zones, cover).groupBy("zone_id").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("code"))
    return top.select("zone_id", "code", name.alias("name"))


query("dominant_class", "zones land_cover", _DOM + "SELECT * FROM d")(dominant)
#: Rules in order, with their cut-offs and names (fixed values).
_RULES = [("f_built >= 0.30", "built-up change"), ("f_water + f_wet >= 0.30", "water/wetland change"), ("f_veg >= 0.40", "vegetation change"), ("f_agri >= 0.40", "agriculture change"), ("f_bare >= 0.40", "bare/soil change")]
_CHAIN = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in _RULES) + " ELSE coalesce(name || ' change', 'unknown') END"
_CT = _DOM + f""", ct AS (SELECT f.zone_id, CASE WHEN f_built >= 0.30 OR EXISTS (SELECT 1 FROM buildings b WHERE {_MEET}) THEN 'building/impervious change'
  WHEN EXISTS (SELECT 1 FROM roads WHERE {DIST2} <= 36) THEN 'road/linear development' ELSE {_CHAIN} END AS change_type FROM f JOIN zones a USING (zone_id) LEFT JOIN d USING (zone_id))"""


def change_type(zones, cover, buildings, roads):
    """A rule cascade over group shares, refined by overlays: buildings, or many built pixels, come first, then roads near by."""
    shares = zone_classes(zones, cover).groupBy("zone_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("code").isin(*codes), F.col("n"))) / F.sum("n"), F.lit(0.0)).alias(f"f_{g.lower()}") for g, codes in GROUPS.items()],
        F.max_by("code", F.struct("n", -F.col("code"))).alias("code"),
    )
    name = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col("code"))
    typed = zones.join(shares, "zone_id", "left").withColumn("name", name).withColumn("kind", F.expr(_CHAIN))
    over = SJ.flag_met(SJ.flag_met(typed, SJ.met(zones, buildings), "built"), near_roads(zones, roads), "near_road")
    kind = F.when(F.col("built") | (F.col("f_built") >= 0.30), "building/impervious change").when(F.col("near_road"), "road/linear development").otherwise(F.col("kind"))
    return over.select("zone_id", kind.alias("change_type"))


query("change_type", "zones land_cover buildings roads", _CT + "SELECT * FROM ct")(change_type)
query("change_type_counts", "zones land_cover buildings roads", _CT + "SELECT change_type, count(*) AS n FROM ct GROUP BY change_type ORDER BY n DESC, change_type LIMIT 10")(lambda z, lc, b, r: change_type(z, lc, b, r).groupBy("change_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "change_type").limit(10))

# --- alerts ----------------------------------------------------------------------------------------------------------
_AL = ", al AS (SELECT *, w * h AS area_m2, CASE WHEN alert_id % 5 = 0 THEN NULL ELSE (alert_id % 100) / 100.0::DOUBLE END AS mean_prob FROM alerts)"


def _scored(a):
    return a.withColumn("area_m2", F.col("w") * F.col("h")).withColumn("mean_prob", F.when(F.col("alert_id") % 5 != 0, (F.col("alert_id") % 100) / 100.0))


_REST = _AL + f", rz AS (SELECT *, EXISTS (SELECT 1 FROM zones b WHERE {_MEET}) AS in_restricted_zone FROM al a)"


def _restricted(a, z):
    return SJ.flag(_scored(a), SJ.box_pairs(a, z, "alert_id", "zone_id"), "alert_id", "in_restricted_zone")


query("alert_filter", "alerts zones", _REST + "SELECT alert_id, area_m2, mean_prob, in_restricted_zone FROM rz WHERE area_m2 >= 400 AND coalesce(mean_prob, 0) >= 0.3")(lambda a, z: AL.passing(_restricted(a, z)).select("alert_id", "area_m2", "mean_prob", "in_restricted_zone"))
query("alert_funnel", "alerts zones", _REST + """, n AS (SELECT count(*) AS k0, count(*) FILTER (area_m2 >= 400) AS k1, count(*) FILTER (area_m2 >= 400 AND coalesce(mean_prob, 0) >= 0.3) AS k2,
  count(*) FILTER (area_m2 >= 400 AND coalesce(mean_prob, 0) >= 0.3 AND in_restricted_zone) AS k3 FROM rz)
SELECT 1 AS step, 'area' AS stage, k1 AS kept, k0 - k1 AS dropped FROM n UNION ALL SELECT 2, 'mean_prob', k2, k1 - k2 FROM n UNION ALL SELECT 3, 'restricted', k3, k2 - k3 FROM n""")(lambda a, z: AL.funnel(_restricted(a, z), only_restricted=True))
query("mean_prob_describe", "alerts", _AL + "SELECT count(mean_prob) AS n, round(avg(mean_prob), 6) AS mean, round(stddev_samp(mean_prob), 6) AS std, min(mean_prob) AS lo, " + ", ".join(f"round(quantile_cont(mean_prob, {q / 100}), 6) AS q{q}" for q in (25, 50, 75)) + ", max(mean_prob) AS hi FROM al")(
    lambda a: AL.describe(_scored(a)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "q25", "q50", "q75", "hi")])
)


@query("alert_measures", "alerts", _AL + "SELECT alert_id, 'ALERT-' || lpad(alert_id::VARCHAR, 8, '0') AS code, area_m2, round(area_m2 / 1e4, 6) AS hectares, round(area_m2 / 1e6, 8) AS km2, CASE WHEN area_m2 < 1000 THEN 'small' WHEN area_m2 < 10000 THEN 'medium' ELSE 'large' END AS size_category, xmin + w / 2 AS cx, ymin + h / 2 AS cy FROM al")
def alert_measures(a):
    """Area, size class (cut-offs 0.1 and 1 ha), code and centroid of each alert's ring."""
    ring = G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    measured = a.withColumn("ring", ring).withColumn("area_m2", F.round(G.ring_area(F.col("ring")), 3)).withColumn("at", G.ring_centroid(F.col("ring")))
    size = F.when(F.col("area_m2") < 1000, "small").when(F.col("area_m2") < 10000, "medium").otherwise("large")
    return measured.select("alert_id", F.concat(F.lit("ALERT-"), F.lpad(F.col("alert_id").cast("string"), 8, "0")).alias("code"), "area_m2", F.round(F.col("area_m2") / 1e4, 6).alias("hectares"), F.round(F.col("area_m2") / 1e6, 8).alias("km2"), size.alias("size_category"), F.round("at.x", 4).alias("cx"), F.round("at.y", 4).alias("cy"))


def _ring():
    return G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])


query("ring_area", "zones", "SELECT zone_id, w * h AS area FROM zones")(lambda z: z.select("zone_id", F.round(G.ring_area(_ring()), 3).alias("area")))
query("ring_centroid", "zones", "SELECT zone_id, xmin + w / 2 AS x, ymin + h / 2 AS y FROM zones")(lambda z: z.select("zone_id", G.ring_centroid(_ring()).alias("p")).select("zone_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y")))
query("bbox_of", "alerts", "SELECT alert_id, xmin, ymin, xmax, ymax FROM alerts")(lambda a: a.select("alert_id", G.bbox(_ring()).alias("b")).select("alert_id", "b.*"))
query("bbox_intersects", "alerts", "SELECT alert_id, xmin <= 60000 AND xmax >= 40000 AND ymin <= 60000 AND ymax >= 40000 AS inside FROM alerts")(lambda a: a.select("alert_id", F.expr("xmin <= 60000 AND xmax >= 40000 AND ymin <= 60000 AND ymax >= 40000").alias("inside")))
query("geom_repair", "zones", "SELECT zone_id, w * h AS area, 5 AS corners FROM zones WHERE zone_id % 4 <> 3")(
    lambda z: z.select("zone_id", G.repair(F.when(F.col("zone_id") % 4 == 0, F.reverse(_ring())).when(F.col("zone_id") % 4 == 1, F.slice(_ring(), 1, 4)).when(F.col("zone_id") % 4 == 3, F.slice(_ring(), 1, 2)).otherwise(_ring())).alias("g")).where("g IS NOT NULL").select("zone_id", F.round(G.signed_area(F.col("g")), 3).alias("area"), F.size("g").alias("corners"))
)
query("feature_clean", "zones", "SELECT zone_id, 4326 AS srid, xmin FROM zones WHERE zone_id % 6 <> 0")(lambda z: z.select("zone_id", F.when(F.col("zone_id") % 6 != 0, _ring()).alias("g"), F.when(F.col("zone_id") % 2 == 0, 4326).alias("srid"), "xmin").where(F.col("g").isNotNull() & (F.size("g") > 0)).select("zone_id", F.coalesce("srid", F.lit(4326)).alias("srid"), "xmin"))
query("aoi_validate", "aoi", "SELECT aoi_id, aoi_id % 7 <> 0 AS good FROM aoi")(lambda a: a.withColumn("xmax", F.when(F.col("aoi_id") % 7 == 0, F.col("xmin")).otherwise(F.col("xmax"))).select("aoi_id", ((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax"))).alias("good")))
_CELLS = "SELECT DISTINCT 0 AS k, gy AS r, gx AS c FROM (SELECT unnest(range(floor(xmin / 1000)::BIGINT, floor((xmax - 1) / 1000)::BIGINT + 1)) AS gx, ymin, ymax FROM zones), LATERAL (SELECT unnest(range(floor(ymin / 1000)::BIGINT, floor((ymax - 1) / 1000)::BIGINT + 1)) AS gy)"
query("geom_union", "zones", f""", m AS ({_CELLS}), e AS (SELECT a.r * 128 + a.c AS s, b.r * 128 + b.c AS t FROM m a JOIN (SELECT m.*, dr, dc FROM m, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS v(dr, dc)) b ON b.r + b.dr = a.r AND b.c + b.dc = a.c),
f AS (SELECT r * 128 + c AS s, r * 128 + c AS t FROM m UNION SELECT f.s, e.t FROM f JOIN e ON e.s = f.t), cc AS (SELECT s // 128 AS r, s % 128 AS c, min(t) AS label FROM f GROUP BY s)
SELECT label, count(*) AS cells, min(c) AS x0, max(c) AS x1, min(r) AS y0, max(r) AS y1 FROM cc GROUP BY label""")(lambda z: geom_union(z))


def geom_union(z, cell=1000):
    """The zones' union on a grid of 1 km: cells that touch along a side become one part."""
    side = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    cells = z.withColumn("c", side("xmin", "xmax")).withColumn("r", side("ymin", "ymax")).select(F.lit(0).alias("k"), "r", "c").distinct()
    return CC.regions(CC.components(cells, ["k"], 128), ["k"]).select("label", F.col("n").alias("cells"), F.col("c0").alias("x0"), F.col("c1").alias("x1"), F.col("r0").alias("y0"), F.col("r1").alias("y1"))


# --- coordinates -----------------------------------------------------------------------------------------------------
_LL = "SELECT alert_id, 72.0::DOUBLE + xmin / 200000 AS lon, 18.0::DOUBLE + ymin / 200000 AS lat FROM alerts"
_LLS = "SELECT alert_id, 72.0D + xmin / 200000 AS lon, 18.0D + ymin / 200000 AS lat FROM {a}"


def _lonlat(a):
    return a.select("alert_id", (72.0 + F.col("xmin") / 200000).alias("lon"), (18.0 + F.col("ymin") / 200000).alias("lat"))


X, Y = G.to_utm("lon", "lat", "zone")
LON, LAT = G.to_wgs84("x", "y", "zone")
query("utm_zone", "alerts", f", p AS ({_LL}) SELECT alert_id, {G.utm_zone('lon')} AS zone FROM p")(lambda a: _lonlat(a).selectExpr("alert_id", f"{G.utm_zone('lon')} AS zone"))
query("to_utm", "alerts", f", p AS ({_LL}), z AS (SELECT *, {G.utm_zone('lon')} AS zone FROM p) SELECT alert_id, round({X}, 3) AS x, round({Y}, 3) AS y FROM z")(lambda a: _lonlat(a).selectExpr("alert_id", "lon", "lat", f"{G.utm_zone('lon')} AS zone").selectExpr("alert_id", f"round({X}, 3) AS x", f"round({Y}, 3) AS y"))
query("to_wgs84", "alerts", f", p AS ({_LL}) SELECT alert_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")(
    lambda a: _lonlat(a).selectExpr("alert_id", "lon", "lat", f"{G.utm_zone('lon')} AS zone").selectExpr("alert_id", "zone", f"{X} AS x", f"{Y} AS y").selectExpr("alert_id", f"round({LON}, 6) AS lon", f"round({LAT}, 6) AS lat")
)
query("transform_bounds", "zones", "SELECT zone_id, xmin * 2 + 10 AS xmin, -(ymax) * 2 AS ymin, xmax * 2 + 10 AS xmax, -(ymin) * 2 AS ymax FROM zones")(
    lambda z: z.select("zone_id", G.bbox(F.transform(_ring(), lambda p: G.point(p["x"] * 2 + 10, -p["y"] * 2))).alias("b")).select("zone_id", "b.*")
)
query("affine_apply", "px", "SELECT scene_id, r, c, 500.0::DOUBLE + c * 10.0 AS x, 9000.0::DOUBLE - r * 10.0 AS y FROM px")(lambda px: px.select("scene_id", "r", "c", (500.0 + F.col("c") * 10.0).alias("x"), (9000.0 - F.col("r") * 10.0).alias("y")))
query("affine_invert", "alerts", "SELECT alert_id, floor((xmin - 500) / 10)::BIGINT AS col, floor((9000 - ymin) / 10)::BIGINT AS row FROM alerts")(lambda a: a.select("alert_id", F.floor((F.col("xmin") - 500) / 10).alias("col"), F.floor((9000 - F.col("ymin")) / 10).alias("row")))
query("latlon_area", "alerts", f", p AS ({_LL}) SELECT alert_id, round(pow(0.0001 * 111.32, 2) * cos(radians(lat)), 12) AS km2 FROM p")(lambda a: _lonlat(a).select("alert_id", F.round(F.pow(F.lit(0.0001 * 111.32), F.lit(2.0)) * F.cos(F.radians("lat")), 12).alias("km2")))
query("osm_ways", "roads", "SELECT road_id AS way_id, CASE WHEN road_id % 3 = 0 THEN 'polygon' ELSE 'line' END AS kind, CASE WHEN road_id % 3 = 0 THEN 4 ELSE 2 END AS n_points, x1 AS first_x FROM roads")(lambda r: _ways(r))


def _ways(r):
    """Nodes and ways as an OSM extract has them, and ways with their coordinates in order again."""
    corners = F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for k, x, y in ((0, "x1", "y1"), (1, "x2", "y2"), (2, "x2", "y1"))])
    nodes = r.select("road_id", F.explode(corners).alias("n")).select((F.col("road_id") * 10 + F.col("n.k")).alias("node_id"), "n.x", "n.y")
    k = F.col("road_id") * 10
    ways = r.select(F.col("road_id").alias("way_id"), F.when(F.col("road_id") % 3 == 0, F.array(k, k + 1, k + 2, k)).otherwise(F.array(k, k + 1)).alias("nodes"))
    return SC.osm_ways(nodes, ways).select("way_id", "kind", F.size("points").alias("n_points"), F.element_at("points", 1)["x"].alias("first_x"))

# --- burning polygons to pixels --------------------------------------------------------------------------------------
query("rasterize_polygons", "zones px", _PIX.format(t="px") + "SELECT DISTINCT scene_id, r, c, 1 AS v FROM zp")(
    lambda z, px: PG.burnt(px.select("scene_id", "r", "c"), scenes(px), ["scene_id"], {"hit": lambda g: PG.burn_grids(zone_polygons(z), g)}).where("hit").select("scene_id", "r", "c", F.lit(1).alias("v"))
)
#: Label values by priority, and the land-cover codes of the last layer (fixed values).
LABELS = {"building": 1, "road": 0, "other": 2, "ignore": 255}
COVERED = (10, 20, 30, 80, 90, 95)
_LINES = f""", sc AS (SELECT DISTINCT scene_id, (scene_id % 10) * 10000.0::DOUBLE AS x0, (scene_id // 10 % 10) * 10000 + 6400.0::DOUBLE AS top FROM land_cover),
q AS (SELECT scene_id, (x1 - x0) / 100 AS ca, (x2 - x0) / 100 AS cb, (top - y1) / 100 AS ra, (top - y2) / 100 AS rb FROM roads, sc),
n AS (SELECT scene_id, abs(cb - ca) >= abs(rb - ra) AS flat, CASE WHEN abs(cb - ca) >= abs(rb - ra) THEN [ca, cb, ra, rb] ELSE [ra, rb, ca, cb] END AS v FROM q),
i AS (SELECT *, unnest(range(greatest(floor(least(v[1], v[2])), 0)::BIGINT, least(floor(greatest(v[1], v[2])), 63)::BIGINT + 1)) AS i FROM n),
j AS (SELECT scene_id, flat, i, floor(v[3] + CASE WHEN v[1] = v[2] THEN 0 ELSE (least(greatest(i + 0.5, least(v[1], v[2])), greatest(v[1], v[2])) - v[1]) / (v[2] - v[1]) END * (v[4] - v[3]))::BIGINT AS k FROM i),
rd AS (SELECT DISTINCT scene_id, CASE WHEN flat THEN k ELSE i END AS r, CASE WHEN flat THEN i ELSE k END AS c FROM j),
g AS (SELECT *, (scene_id % 10) * 10000 + c * 100 + 50 AS x, (scene_id // 10 % 10) * 10000 + (63 - r) * 100 + 50 AS y FROM land_cover),
bl AS (SELECT DISTINCT scene_id, r, c FROM g JOIN buildings ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax)"""


def burn_labels(buildings, roads, cover):
    """Buildings before roads before land cover before nothing; roads are lines."""
    boxes = buildings.select("xmin", "ymin", "xmax", "ymax").distinct().select(F.array(G.box_ring(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])).alias("rings"))
    key = ["scene_id", "r", "c"]
    layers = {"building": lambda g: PG.burn_grids(boxes, g), "road": lambda g: PG.burn_lines(roads, g, ["_grid"])}
    both = PG.burnt(cover, scenes(cover), ["scene_id"], layers)
    value = F.when(F.col("building"), LABELS["building"]).when(F.col("road"), LABELS["road"]).when(F.col("code").isin(*COVERED), LABELS["other"]).otherwise(LABELS["ignore"])
    return both.select(*key, value.alias("label"))


query("burn_labels_priority", "buildings roads land_cover", _LINES + f"""
SELECT l.scene_id, l.r, l.c, CASE WHEN bl.r IS NOT NULL THEN {LABELS["building"]} WHEN rd.r IS NOT NULL THEN {LABELS["road"]} WHEN code IN {COVERED} THEN {LABELS["other"]} ELSE {LABELS["ignore"]} END AS label
FROM land_cover l LEFT JOIN bl ON bl.scene_id = l.scene_id AND bl.r = l.r AND bl.c = l.c LEFT JOIN rd ON rd.scene_id = l.scene_id AND rd.r = l.r AND rd.c = l.c""")(burn_labels)
