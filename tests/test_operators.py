"""Hand goldens and invariants."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradelta.functions import geometry as G
from terradelta.operators import components as CC
from terradelta.operators import manifest, metrics, outlines, raster, spatial, splits
from terradelta.sinks import writers
from terradelta.sources import readers


def pixels(spark, text, keys="scene_id"):
    found = [(0, r, c, int(v)) for r, line in enumerate(text.split()) for c, v in enumerate(line) if v != "."]
    return spark.createDataFrame(found, f"{keys} long, r long, c long, v int")


def test_components_connectivity_and_tile_borders(spark):
    px = pixels(spark, "1.... .1... ..111 ....1 1...1")
    label = lambda conn, tile: {(x.r, x.c): x.label for x in CC.components(px, ["scene_id"], 8, conn, tile).collect()}
    assert label(4, 2) == label(4, 32) == {(0, 0): 0, (1, 1): 9, (2, 2): 18, (2, 3): 18, (2, 4): 18, (3, 4): 18, (4, 4): 18, (4, 0): 32}
    assert set(label(8, 2).values()) == {0, 32} and label(8, 2) == label(8, 32)


def test_components_of_nothing(spark):
    assert CC.components(pixels(spark, "1").where("v = 0"), ["scene_id"], 8).count() == 0


def test_erosion_at_the_border_and_opening_in_the_mask(spark):
    px = pixels(spark, "1111 1111 1111 1110")
    grid = lambda df: {(x.r, x.c) for x in df.where("v = 1").collect()}
    assert grid(raster.erode(px, ["scene_id"])) == {(1, 1), (1, 2), (2, 1)}
    assert grid(raster.opening(px, ["scene_id"])) <= grid(px) <= grid(raster.dilate(px, ["scene_id"]))


def test_stride_windows(spark):
    at = lambda **k: spark.range(1).select(F.explode(raster.windows(10, 10, 4, 3, **k)).alias("w")).select("w.y").distinct().orderBy("y").collect()
    assert [r.y for r in at()] == [0, 3, 6] and [r.y for r in at(align=True)] == [0, 3, 6]


def test_rotation_four_times_is_identity(spark):
    df = spark.range(16).select(F.expr("id div 4").alias("r"), (F.col("id") % 4).alias("c"))
    out = df
    for _ in range(4):
        r, c = raster.rotate("rot90", F.col("r"), F.col("c"), 4)
        out = out.select(r.alias("r"), c.alias("c"))
    assert [tuple(x) for x in out.collect()] == [tuple(x) for x in df.collect()]


def test_grid_join_is_the_cross_join(spark):
    rng = np.random.default_rng(3)
    boxes = lambda n, size: [(int(i), float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 400, (2, n)), *rng.integers(1, size, (2, n)), strict=True))]
    a, b = boxes(60, 50), boxes(40, 120)
    schema = "id long, xmin double, ymin double, xmax double, ymax double"
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    got = spatial.box_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).withColumnRenamed("id", "other"), "id", "other", cell=37.0)
    found = [(r.id, r.other) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_spatial_joins_have_no_cartesian_product(spark):
    df = spark.range(10).selectExpr("id", "0D AS xmin", "0D AS ymin", "1D AS xmax", "1D AS ymax")
    plan = spatial.box_pairs(df, df.withColumnRenamed("id", "other"), "id", "other")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_utm_of_known_points(spark):
    # Zone 31 meets the equator at its central meridian at 500 km east, 0 north.
    x, y = G.to_utm("lon", "lat", "zone")
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 45.0), (4.5, 45.0)], "lon double, lat double").selectExpr("lon", "lat", f"{G.utm_zone('lon')} AS zone").selectExpr("lon", "lat", "zone", f"{x} AS x", f"{y} AS y")
    lon, lat = G.to_wgs84("x", "y", "zone")
    got = df.selectExpr("*", f"{lon} AS lon2", f"{lat} AS lat2").collect()
    assert got[0].zone == 32631 and got[0].x == pytest.approx(500000) and got[0].y == pytest.approx(0, abs=1e-6)
    assert got[1].y == pytest.approx(4982950.4, abs=0.2)
    assert all(r.lon == pytest.approx(r.lon2, abs=1e-7) and r.lat == pytest.approx(r.lat2, abs=1e-7) for r in got)


def test_ranked_split_covers_all_rows_once(spark):
    got = splits.ranked(spark.range(1000), "id", 0.2, 0.1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"val": 200, "test": 100, "train": 700}


def test_files_are_read(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(1, 2, 3))
    row = readers.read_npy(spark, str(tmp_path / "*.npy")).collect()[0]
    assert row.shape == [1, 2, 3] and row["values"] == [0, 1, 2, 3, 4, 5]
    (tmp_path / "names.txt").write_text("a\n\nb \n")
    files = readers.read_manifest(spark, str(tmp_path), "*.npy")
    assert [(r.stem, r.ext) for r in files.collect()] == [("a", ".npy")]
    assert readers.filter_by_list(files, str(tmp_path / "names.txt"), "stem").count() == 1
    with pytest.raises(ValueError, match="missing columns: y"):
        readers.require(spark.range(1), "id", "y")


def test_png_image_is_read_in_rgb_order(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"\0" + bytes([255, 0, 51, 0, 102, 0])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    row = readers.read_images(spark, str(tmp_path)).collect()[0]
    assert [round(v, 2) for v in row["values"]] == [1.0, 0.0, 0.2, 0.0, 0.4, 0.0]


def test_incomplete_triples_are_the_rest(spark):
    files = spark.createDataFrame([("s", "1", "A", "x"), ("s", "1", "B", "y"), ("s", "1", "label", "z"), ("s", "2", "A", "w")], "split string, stem string, tag string, path string")
    t = manifest.triples(files, "split", "stem")
    assert manifest.complete(t).count() == 1 and manifest.incomplete(t).count() == 1


def test_focal_moves_pixels_once_and_crosses_tiles(spark):
    px = spark.range(900).selectExpr("id div 900 AS scene_id", "id div 30 AS r", "id % 30 AS c", "cast(id * 7 % 11 AS double) AS v")
    df = raster.focal(px, ["scene_id"], "v", "square3", [F.sum("v").alias("v"), F.count("*").alias("n")], tile=7)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    grid = (np.arange(900) * 7 % 11).reshape(30, 30)
    padded = np.pad(grid, 1)
    want = sum(padded[1 + a : 31 + a, 1 + b : 31 + b] for a in (-1, 0, 1) for b in (-1, 0, 1))
    got = {(x.r, x.c): (x.v, x.n) for x in df.collect()}
    assert len(got) == 900 and all(got[r, c][0] == want[r, c] for r in range(30) for c in range(30))
    assert got[0, 0][1] == 4 and got[15, 15][1] == 9


def test_geojson_keeps_parts_and_holes(spark, tmp_path):
    box = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [("MultiPolygon", [[box(0, 9), box(1, 2), box(4, 5)], [box(20, 22)]]), ("Polygon", [box(0, 4), box(1, 3)]), ("LineString", [[0, 0], [3, 4]]), ("Point", [1, 2])]
    features = [{"type": "Feature", "properties": {"n": n}, "geometry": {"type": kind, "coordinates": c}} for n, (kind, c) in enumerate(shapes)]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    plain = lambda ring: ring and [[p.x, p.y] for p in ring]
    got = [(json.loads(r.props)["n"], r.part, plain(r.ring), [plain(h) for h in r.holes]) for r in readers.read_geojson(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[:2]) == [(0, 0, box(0, 9), [box(1, 2), box(4, 5)]), (0, 1, box(20, 22), []), (1, 0, box(0, 4), [box(1, 3)]), (2, 0, [[0, 0], [3, 4]], []), (3, 0, None, [])]


def test_summary_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("finite_count,name,valid_ratio\n7,x_A.npy,0.5\n,y_A.npy,\n")
    got = readers.read_summary_csv(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("name", "string"), ("valid_ratio", "double"), ("finite_count", "bigint")]
    assert sorted(map(tuple, got.collect())) == [("x_A.npy", 0.5, 7), ("y_A.npy", None, None)]
    (tmp_path / "b.csv").write_text("name,valid_ratio\nx,1\n")
    with pytest.raises(ValueError, match="finite_count"):
        readers.read_summary_csv(spark, str(tmp_path / "b.csv"))


def test_lookup_of_a_missing_row(spark):
    assert manifest.lookup(spark.range(9), "id", 7).collect()[0].id == 7
    with pytest.raises(ValueError, match="id = 9"):
        manifest.lookup(spark.range(9), "id", 9)


def test_scans_read_files(spark):
    import __spark_entry__ as entry

    for name, folder in (("scan_summary_csv", "summary"), ("scan_index", "index"), ("scan_detections", "detections"), ("scan_split_list", "list")):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0 and any(f"/{folder}-" in x for x in df.inputFiles()), name


def test_ranks_within_range_slices(spark):
    df = spark.range(2000).selectExpr("if(id % 10 < 8, 'train', if(id % 10 = 8, 'val', NULL)) AS split", "lpad(cast(id * 7919 % 2003 AS string), 4, '0') AS path")
    got = manifest.ranked(df, "path", "a", "split")
    for split in ("train", "val", None):
        own = [r for r in got.collect() if r.split == split]
        want = sorted(r.path for r in df.collect() if r.split == split)
        assert [r.a for r in sorted(own, key=lambda r: r.k)] == want and sorted(r.k for r in own) == list(range(1, len(want) + 1))
    plan = got._jdf.queryExecution().toString()
    assert "_s" in plan.split("Window [row_number()", 1)[1].split("\n")[0].split("windowspecdefinition", 1)[1].split(" ASC")[0]


def ring_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


@pytest.mark.parametrize(("conn", "want"), [(4, [[9.0, -1.0], [1.0], [1.0]]), (8, [[9.0, -1.0], [2.0]])])
def test_outlines_have_holes_and_part_at_corners(spark, conn, want):
    """A square ring around a hole, and two pixels that meet at a corner only."""
    cells = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(5, 5), (6, 6)]
    labelled = CC.components(spark.createDataFrame([(1, r, c) for r, c in cells], "k long, r long, c long"), ["k"], 64, conn)
    got = outlines.outlines(labelled, ["k"], (2.0, 100.0, -2.0, 50.0), conn).orderBy("label").collect()
    rings = [[[(p.x, p.y) for p in ring] for ring in row.rings] for row in got]
    assert [[ring_area(r) / 4 for r in row] for row in rings] == want
    assert rings[0][0][0] == rings[0][0][-1] and len(rings[0][0]) == 5 and all(100 <= x <= 106 and 44 <= y <= 50 for x, y in rings[0][0])


def test_outlines_add_up_to_random_regions(spark):
    rng = np.random.default_rng(4)
    for conn in (4, 8):
        mask = spark.createDataFrame([(0, int(r), int(c)) for r, c in np.argwhere(rng.random((40, 40)) < 0.6)], "k long, r long, c long")
        labelled = CC.components(mask, ["k"], 64, conn, tile=16)
        size = {r.label: r.n for r in CC.regions(labelled, ["k"]).collect()}
        edges = {r.label: r["count"] for r in outlines.boundary(labelled, ["k"]).groupBy("label").count().collect()}
        for row in outlines.outlines(labelled, ["k"], conn=conn).collect():
            rings = [[(p.x, p.y) for p in ring] for ring in row.rings]
            assert sum(map(ring_area, rings)) == size[row.label] and ring_area(rings[0]) > 0 and all(ring_area(r) < 0 for r in rings[1:])
            assert sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for ring in rings for a, b in zip(ring, ring[1:])) == edges[row.label]


def test_opening_by_an_even_element_moves_nothing(spark):
    cells = [(r, c) for r in range(4) for c in range(4)] + [(9, 9)]
    px = raster.dense(spark.createDataFrame([(0, r, c, 1) for r, c in cells], "k long, r long, c long, v int"), ["k"], "v", 12, 12, 0)
    got = {(x.r, x.c) for x in raster.opening(px, ["k"], "v", "square2").where("v = 1").collect()}
    assert got == set(cells) - {(9, 9)}
    assert {(x.r, x.c) for x in raster.opening(px, ["k"], "v", "square2", times=2).where("v = 1").collect()} == got


def test_labels_are_cleaned_class_by_class(spark):
    grid = np.zeros((12, 12), int)
    grid[2:7, 2:7], grid[4, 4], grid[9, 9], grid[2:4, 8:10] = 1, 2, 3, 2
    px = spark.createDataFrame([(0, r, c, int(grid[r, c])) for r in range(12) for c in range(12)], "k long, r long, c long, label int")
    out = np.zeros_like(grid)
    for x in raster.clean_labels(px, ["k"], "label", [1, 2, 3]).collect():
        out[x.r, x.c] = x.label
    want = grid.copy()
    want[9, 9] = 0  # a lone pixel goes
    want[4, 4] = 0  # the hole is closed by class 1, then class 2's lone pixel becomes background
    assert (out == want).all()


def test_boxes_of_all_sizes_meet_in_few_cells(spark):
    rng = np.random.default_rng(5)
    sizes = [1, 10, 1e3, 1e5, 3e6]
    boxes = [(i, float(x), float(y), float(x + w), float(y + w)) for i, (x, y, w) in enumerate(zip(rng.uniform(-1e6, 1e6, 80), rng.uniform(-1e6, 1e6, 80), rng.choice(sizes, 80), strict=True))]
    df = spark.createDataFrame([*boxes, (80, 5.0, 5.0, 5.0, 5.0), (81, 5.0, 5.0, 5.0, 5.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    rows = [tuple(r) for r in df.collect()]
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] - 2 <= q[3] and q[1] <= p[3] + 2 and p[2] - 2 <= q[4] and q[2] <= p[4] + 2)
    assert sorted((r.id, r.other) for r in spatial.box_pairs(df, df.withColumnRenamed("id", "other"), "id", "other", buffer=2.0).collect()) == want
    assert spatial._celled(df, list(range(14)), 1000.0).count() <= 82 * 14 * 4
    assert spatial.box_pairs(df.limit(0), df.withColumnRenamed("id", "other").limit(0), "id", "other").count() == 0


def test_points_in_a_ring(spark):
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0))])
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 0.5, True), (2.0, 3.0, False), (5.0, 1.0, False), (3.5, 2.9, True), (-1.0, 1.0, False)], "x double, y double, want boolean")
    assert df.where(G.in_ring(ring, F.col("x"), F.col("y")) != F.col("want")).isEmpty()
    assert df.select(G.ring_length(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (3, 4), (0, 0))]))).first()[0] == 10.0


def test_draws_follow_the_weights(spark):
    df = spark.range(50).select("id", (F.col("id") % 5).alias("w")).repartition(7)
    got = splits.weighted_draws(df, "id", "w", 4000).collect()
    assert sorted(r.draw for r in got) == list(range(4000)) and all(r.id % 5 == r.w > 0 for r in got)
    share = sum(r.w for r in got) / 4000
    assert abs(share - (1 + 4 + 9 + 16) / 10) < 0.1
    ends = np.cumsum([i % 5 for i in range(50)])
    unit = {r.id: r.u for r in spark.range(4000).select("id", splits.uniform(F.col("id")).alias("u")).collect()}
    assert all(r.id == int(np.searchsorted(ends, unit[r.draw] * ends[-1], "right")) for r in got)
    assert splits.weighted_draws(df.limit(0), "id", "w", 5).count() == 0


def test_lovasz_is_that_of_sorted_errors(spark):
    rng = np.random.default_rng(6)
    p, g = rng.random(300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(p, g, strict=True)], "k long, p double, g double")

    def by_sorting(error, positive):
        order = np.argsort(-error)
        t, pos = positive.sum(), positive[order]
        jac = 1 - (t - pos.cumsum()) / (t + (1 - pos).cumsum())
        return float((np.maximum(error[order], 0) * np.diff(jac, prepend=0)).sum())

    one = metrics.lovasz(df, F.abs(F.col("g") - F.col("p")), F.col("g") == 1, "k").first()
    hinge = metrics.lovasz(df, 1 - (4 * F.col("p") - 2) * (2 * F.col("g") - 1), F.col("g") == 1, "k").first()
    assert abs(one.lovasz - by_sorting(abs(g - p), g)) < 1e-6 and one.present
    assert abs(hinge.lovasz - by_sorting(1 - (4 * p - 2) * (2 * g - 1), g)) < 1e-6


def test_new_rows_are_appended_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "id long, v string")
    writers.append_new(frame([1, 2, 2]), path, "id")
    writers.append_new(frame([2, 3]), path, "id")
    open(f"{path}._appending", "w").close()
    with pytest.raises(RuntimeError, match="another writer"):
        writers.append_new(frame([9]), path, "id")
    os.remove(f"{path}._appending")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_bad_rows_are_set_aside(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", None)], "name string, q double")
    writers.quarantine(df, F.col("q") < 0.5, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert sorted(r.name for r in spark.read.parquet(f"{tmp_path}/good").collect()) == ["b", "c"] and [r.name for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["a"]


def test_an_index_without_a_column_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/index")
    with pytest.raises(ValueError, match="missing columns: split"):
        readers.read_index(spark, f"{tmp_path}/index", "id", "split")


def test_a_catalogue_of_nothing_is_an_error(spark):
    none = spark.createDataFrame([], "scene_id long, r long, c long")
    with pytest.raises(ValueError, match="no raster"):
        spatial.footprints(none, ["scene_id"], F.lit(0.0), F.lit(0.0), 10.0, "EPSG:32643", "x", "y")


def test_the_checkpoint_folder_must_be_shared(spark, monkeypatch):
    from terradelta import checkpoints

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.shared_folder(Session())


def test_no_window_over_a_whole_scene(spark):
    from terradelta.plans.catalog import QUERIES

    for name in ("threshold_fallback", "scale_unit", "mask_remap_dirty_only"):
        assert "Window" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString(), name
