"""What shows on larger tables only: groups beyond a task, equal shapes, equal grids, many tiles."""

import random

import pytest
from pyspark.sql import functions as F

from terradelta.functions import geometry as G
from terradelta.operators import alerts as AL
from terradelta.operators import components as CC
from terradelta.operators import outlines as OL
from terradelta.operators import polygons as PG
from terradelta.operators import spatial as SJ
from terradelta.operators import tiles


def test_figures_of_a_group_beyond_a_task(spark, monkeypatch):
    from terradelta.operators import quantiles as Q

    monkeypatch.setattr(Q, "SMALL", 50)
    values = [(k * 37 % 101) / 101 for k in range(1001)]
    got = AL.describe(spark.createDataFrame([(v,) for v in [*values, None]], "mean_prob double")).first()
    values.sort()
    assert (got["n"], got["lo"], got["hi"]) == (1001, values[0], values[-1])
    assert [got["q25"], got["q50"], got["q75"]] == [values[250], values[500], values[750]]
    clash = spark.createDataFrame([(k % 2, k % 3, float(v)) for k, v in enumerate(range(1001))], "_all int, _lo int, v double")
    direct = Q.quantiles(clash, ["_all", "_lo"], "v", [0.5], small=10**6).collect()
    assert sorted(map(tuple, Q.quantiles(clash, ["_all", "_lo"], "v", [0.5], small=20).collect())) == sorted(map(tuple, direct))


def test_rings_are_cut_once_and_rectangles_by_their_ends(spark):
    shape = "array<struct<x:double,y:double>>"
    rings = [[(0, 0), (4, 0), (4, 3), (0, 3)], [(0, 0), (0, 3), (4, 3), (4, 0)], [(5, 0), (9, 0), (9, 3), (5, 3)], [(2, 1), (8, 1), (2, 5)], [(9, 9), (10, 9), (10, 10), (9, 10)], [(0, 0), (2, 0), (2, 1), (0, 1)]]
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]]) for k, ring in enumerate(rings)], f"k int, ring {shape}")
    box = [F.lit(float(v)) for v in (2, 1, 6, 4)]
    got = df.select("k", G.clipped(F.col("ring"), *box).alias("b")).select("k", "b.*").orderBy("k").collect()
    slow = df.select("k", G.clip_ring(F.col("ring"), *box).alias("ring")).select("k", G.bbox(F.col("ring")).alias("b"), G.ring_area(F.col("ring")).alias("area")).select("k", "b.*", "area").orderBy("k").collect()
    assert got == slow and got[0][1:] == (2.0, 1.0, 4.0, 3.0, 4.0) and got[4]["area"] is None and got[5]["area"] == 0.0
    far = spark.range(1).selectExpr("0D AS a", "1D AS b")
    far = far.select(G.clipped(G.box_ring(F.col("a"), F.col("a"), F.col("b"), F.col("b")), *box)["area"].alias("area"))
    assert far.first()["area"] is None


def test_equal_boxes_are_searched_once_and_make_no_pairs(spark):
    schema = "id long, xmin double, ymin double, xmax double, ymax double"
    left = [(k, float(k % 3 * 10), 0.0, k % 3 * 10 + 1.0, 1.0) for k in range(300)] + [(300, None, 0.0, 1.0, 1.0), (301, -5.0, -5.0, 50.0, 50.0)]
    right = [(k, 0.5, 0.5, 2.0, 2.0) for k in range(300)] + [(300, 20.5, 3.0, 21.0, 4.0)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r["id"]: r["hit"] for r in SJ.flag_met(a, SJ.met(a, b), "hit").collect()}
    assert got == {k: k == 301 or (k < 300 and k % 3 == 0) for k in range(302)}
    near = {r["id"]: r["hit"] for r in SJ.flag_met(a, SJ.met(a, b, buffer=2.0, exact="r_ymin > 2"), "hit").collect()}
    assert near == {k: k == 301 or (k < 300 and k % 3 == 2) for k in range(302)}
    assert SJ.met(a, b).count() == 2 and SJ.met(a, b.limit(0)).count() == 0
    plan = SJ.met(a, b)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


SHAPE = "array<array<struct<x:double,y:double>>>"
GRID = "scene long, x0 double, y1 double, res double, height int, width int"


def _world(spark, copies=5, scenes=7, n=300):
    """Polygons of few shapes, scenes on two grids that reach beyond a region of pixels, and what brute force finds."""
    rng = random.Random(8)
    ring = lambda x, y, w: [(x, y), (x + w, y + 0.1 * w), (x + 0.9 * w, y + w), (x + 0.5 * w, y + 0.45 * w), (x + 0.05 * w, y + 0.9 * w)]
    own = [[ring(3.3, 5.7, 60.0)], [ring(200.2, 240.4, 90.0), ring(10.1, 10.2, 5.0)], [ring(100.3, 250.9, 8.0)]]
    polygons = [(k, [[{"x": x, "y": y} for x, y in r] for r in own[k % 3]]) for k in range(3 * copies)]
    grids = [(s, 0.0 if s % 2 else 0.5, float(n), 1.0, n, n) for s in range(scenes)]
    pixels = {}
    for s, *_ in grids:
        for _ in range(4000):
            pixels[s, rng.randrange(n), rng.randrange(n)] = (rng.randrange(10) / 8, rng.randrange(3))
    want = {}
    for k in range(3):
        rings = [[*r, r[0]] for r in own[k]]
        for (s, r, c), (v, cls) in pixels.items():
            x, y = grids[s][1] + c + 0.5, n - r - 0.5
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for g in rings for (x1, y1), (x2, y2) in zip(g, g[1:], strict=False)) % 2:
                want.setdefault((k, s, r, c), (v, cls))
    px = spark.createDataFrame([(*at, *v) for at, v in pixels.items()], "scene long, r long, c long, v double, cls int")
    return spark.createDataFrame(polygons, f"id long, rings {SHAPE}"), px, spark.createDataFrame(grids, GRID), want, 3 * copies


def test_zonal_sums_in_blocks_of_scenes_and_spans(spark, monkeypatch):
    polygons, px, scenes, want, n = _world(spark)
    members, shapes = PG.shapes(polygons, "id")
    assert shapes.count() == 3 and sorted(map(tuple, members.collect())) == [(k, k % 3) for k in range(n)]
    runs = PG.spans(shapes, PG.grids(scenes, ["scene"])[0], "_shape", ["_grid"]).count()
    assert runs * 3 < PG.spans(shapes, scenes, "_shape", ["scene"]).count()
    for blocks, spans in ((16, 100_000), (2, 20)):
        monkeypatch.setattr(PG, "SCENES", blocks)
        monkeypatch.setattr(PG, "SPANS", spans)
        sums = {"s": F.when(F.col("v") < 1, F.col("v")), "n": F.lit(1)}
        for keys, stacked in ((["scene"], False), ([], True)):
            expected = {}
            for (k, s, _, _), (v, cls) in want.items():
                a = expected.setdefault((k, cls) if stacked else (k, s, cls), [None, 0])
                a[0] = (a[0] or 0.0) + v if v < 1 else a[0]
                a[1] += 1
            got = PG.zonal(shapes, px, scenes, "_shape", ["scene"], sums, ["cls"], stacked=stacked)
            assert {tuple(x[c] for c in ["_shape", *keys, "cls"]): [x["s"], x["n"]] for x in got.collect()} == expected


def test_pixels_are_burnt_once_for_a_grid(spark):
    polygons, px, scenes, want, _ = _world(spark)
    got = PG.burnt(px, scenes, ["scene"], {"hit": lambda g: PG.burn_grids(polygons.where("id <> 1"), g), "none": lambda g: PG.burn_grids(polygons.where("id < 0"), g)})
    assert got.columns == [*px.columns, "hit", "none"] and got.count() == px.count()
    assert {(x["scene"], x["r"], x["c"]) for x in got.where("hit").collect()} == {at[1:] for at in want}
    assert got.where("none").count() == 0


@pytest.mark.parametrize("conn", [4, 8])
def test_many_tiles_share_a_call_and_rings_cross_them(spark, conn):
    rng = random.Random(conn)
    n = 45
    scenes = {s: {(r, c) for r in range(n) for c in range(n) if rng.random() < 0.45 + 0.1 * s} for s in (1, 2)}
    mask = spark.createDataFrame([(s, r, c) for s, own in scenes.items() for r, c in own], "s long, r long, c long")
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    want = {}
    for s, own in scenes.items():
        left = set(own)
        while left:
            stack = [min(left)]
            region = {stack[0]}
            while stack:
                r, c = stack.pop()
                for a, b in steps:
                    if (r + a, c + b) in left and (r + a, c + b) not in region:
                        region.add((r + a, c + b))
                        stack.append((r + a, c + b))
            left -= region
            want[s, min(r * 64 + c for r, c in region)] = region
    for tile, batch in ((7, 10000), (7, 5), (64, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            labelled = CC.components(mask, ["s"], 64, conn, tile=tile).cache()
            got = {}
            for x in labelled.collect():
                got.setdefault((x["s"], x["label"]), set()).add((x["r"], x["c"]))
            assert got == want
            pieces = OL.paths(labelled, ["s"], conn, tile=tile)
            measured = OL.measures(pieces, ["s"]).collect()
            assert {(x["s"], x["label"]): x["area"] for x in measured} == {k: float(len(v)) for k, v in want.items()}
            sides = {k: sum((r + a, c + b) not in v for r, c in v for a, b in steps[:4]) for k, v in want.items()}
            assert {(x["s"], x["label"]): x["perimeter"] for x in measured} == sides
            rings = {}
            for x in pieces.collect():
                rings.setdefault((x["s"], x["label"], x["ring"]), []).append((x["pos"], [tuple(p) for p in x["points"]]))
            for own in rings.values():
                own = [p for _, p in sorted(own)]
                assert all(a[-1] == b[0] for a, b in zip(own, [*own[1:], own[0]], strict=True))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a call for each tile would be as many calls as tiles
    calls = spark.sparkContext.accumulator(0)

    def run(p, group):
        calls.add(1)
        return p

    small = spark.range(900).selectExpr("id div 3 AS k", "id % 3 AS r")
    assert tiles.map_tiles(small, ["k"], run, small.schema).count() == 900
    assert calls.value <= 16
