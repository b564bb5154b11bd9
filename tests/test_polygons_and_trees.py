"""Scan conversion, pyramids and component trees against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terradelta.operators import component_tree as CT
from terradelta.operators import polygons as PG

RINGS = "id long, rings array<array<struct<x:double,y:double>>>"
GRID = "scene long, x0 double, y1 double, res double, height int, width int"


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, x, y, size, corners):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return [(x + size * (0.3 + rng.random()) * math.cos(t), y + size * (0.3 + rng.random()) * math.sin(t)) for t in turns]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    polygons = {k: [star(rng, rng.uniform(-5, 45), rng.uniform(-5, 45), rng.uniform(1, 18), rng.randint(3, 12)) for _ in range(rng.randint(1, 3))] for k in range(8)}
    polygons[8] = [[(2.0, 2.0), (30.0, 2.0), (30.0, 30.0), (2.0, 30.0)], [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]  # a hole, edges between centres
    polygons[9] = [[(1.0, 1.0), (2.0, 2.0)]]
    scenes = [(0, 0.0, 40.0, 1.0, 40, 40), (1, 20.3, 60.7, 0.5, 37, 53)]
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in polygons.items()] + [(10, None), (11, [])]
    want = set()
    for k, rings in polygons.items():
        for s, x0, y1, res, h, w in scenes:
            want |= {(k, s, r, c) for r in range(h) for c in range(w) if inside([g for g in rings if len(g) > 2], x0 + (c + 0.5) * res, y1 - (r + 0.5) * res)}
    return spark.createDataFrame(rows, RINGS), spark.createDataFrame(scenes, GRID), want, scenes


def test_spans_follow_the_even_odd_rule(world):
    polygons, scenes, want, _ = world
    runs = PG.spans(polygons, scenes, "id", ["scene"], cell=10.0)
    got = [tuple(r) for r in PG.cells(runs).select("id", "scene", "r", "c").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r)[:3] for r in PG.burn(polygons, scenes, ["scene"]).collect()} == {w[1:] for w in want}
    top = PG.burn(polygons, scenes, ["scene"], value="id").collect()
    assert {tuple(r) for r in top} == {(s, r, c, max(k for k, *at in want if at == [s, r, c])) for _, s, r, c in want}
    assert PG.burn(polygons.where("id > 9"), scenes, ["scene"]).count() == 0


def test_a_pyramid_gives_the_pixels_sums_with_fewer_of_them(world):
    polygons, scenes, want, grids = world
    spark = polygons.sparkSession
    px = spark.createDataFrame([(s, r, c, (r * 7 + c * 3) % 11 + 0.5, (r + c) % 3) for s, _, _, _, h, w in grids for r in range(h) for c in range(w) if (r * c) % 5], "scene long, r long, c long, v double, cls int")
    value = {(x["scene"], x["r"], x["c"]): (x["v"], x["cls"]) for x in px.collect()}
    sums = PG.zonal(polygons, px, scenes, "id", ["scene"], {"s": F.col("v"), "n": F.lit(1)}, ["cls"]).collect()
    expected = {}
    for k, s, r, c in want:
        if (s, r, c) in value:
            v, cls = value[s, r, c]
            a = expected.setdefault((k, s, cls), [0.0, 0])
            a[0] += v
            a[1] += 1
    assert {(x["id"], x["scene"], x["cls"]): [x["s"], x["n"]] for x in sums} == expected
    runs = PG.spans(polygons, scenes, "id", ["scene"], cell=10.0)
    tiles = PG.levelled(runs, ["id", "scene"], levels=2, factor=2).collect()
    back = [(t["id"], t["scene"], t["r"] * 2 ** t["level"] + a, t["c"] * 2 ** t["level"] + b) for t in tiles for a in range(2 ** t["level"]) for b in range(2 ** t["level"])]
    assert len(back) == len(set(back)) and set(back) == want
    assert max(t["level"] for t in tiles) == 2 and len(tiles) < len(want) / 2


def test_lines_burn_one_pixel_a_step(spark):
    scenes = spark.createDataFrame([(0, 0.0, 10.0, 1.0, 10, 10)], GRID)
    lines = spark.createDataFrame([(0.5, 9.5, 4.5, 9.5), (7.2, 9.9, 7.8, 0.1), (2.0, 2.0, 5.0, 5.0), (-4.0, 1.5, 0.5, 1.5), (20.0, 20.0, 30.0, 30.0), (3.3, 3.3, 3.3, 3.3)], "x1 double, y1 double, x2 double, y2 double")
    got = {(r["r"], r["c"]) for r in PG.burn_lines(lines, scenes, ["scene"]).collect()}
    assert {(0, c) for c in range(5)} | {(r, 7) for r in range(10)} | {(8, 0), (6, 3)} <= got
    assert len([p for p in got if p[1] in (2, 3, 4) and p[0] not in (0, 6)]) >= 2


def flood(level, k, conn):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    size, seen = {}, set()
    for at in level:
        if level[at] < k or at in seen:
            continue
        region, stack = {at}, [at]
        while stack:
            r, c = stack.pop()
            for a, b in steps:
                to = (r + a, c + b)
                if level.get(to, 0) >= k and to not in region:
                    region.add(to)
                    stack.append(to)
        seen |= region
        size.update(dict.fromkeys(region, len(region)))
    return size


@pytest.mark.parametrize("conn", [4, 8])
def test_component_tree_is_a_labelling_for_each_threshold(spark, monkeypatch, conn):
    monkeypatch.setattr(CT, "GROUP", 2)
    rng = random.Random(conn)
    n = 23
    scenes = {s: {(r, c): rng.choice([0, 1, 1, 2, 2, 3, 4]) for r in range(n) for c in range(n) if rng.random() < 0.9} for s in range(2)}
    areas = [1, 4, 30]
    px = spark.createDataFrame([(s, r, c, v) for s, level in scenes.items() for (r, c), v in level.items()], "s long, r int, c int, level int")
    got = {(x["s"], x["r"], x["c"]): x["reach"] for x in CT.reaches(px, ["s"], areas, n, conn, tile=4).collect()}
    for s, level in scenes.items():
        sizes = {k: flood(level, k, conn) for k in range(1, 5)}
        want = {at: [max((k for k in range(1, v + 1) if sizes[k][at] >= a), default=0) for a in areas] for at, v in level.items() if v}
        assert {at[1:]: r for at, r in got.items() if at[0] == s} == want
    assert CT.reaches(px.where("level > 9"), ["s"], areas, n, conn).count() == 0


def test_radix_selection_gives_percentiles(spark):
    from terradelta.operators.quantiles import quantiles

    rng = random.Random(4)
    values = {0: [rng.gauss(0, 1) for _ in range(700)], 1: [10.0 ** rng.uniform(-200, 200) for _ in range(500)], 2: [3.0] * 400, 3: [float(rng.randint(0, 3)) for _ in range(600)], 4: [1.0, 2.0], 5: [float("nan"), None], 6: [-1e9] + [rng.random() for _ in range(300)]}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k long, v double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    want = {r["k"]: (r["n"], r["q"]) for r in df.groupBy("k").agg(F.count(F.when(~F.isnan("v"), F.col("v"))).alias("n"), F.percentile(F.when(~F.isnan("v"), F.col("v")), F.array(*map(F.lit, shares))).alias("q")).collect()}
    for small, bins in ((10**6, 16), (20, 512), (3, 4096)):
        got = {r["k"]: (r["n"], r["q"]) for r in quantiles(df, ["k"], "v", shares, small=small, bins=bins).collect()}
        assert got == want, (small, bins)


@pytest.mark.parametrize("kind", ["mean", "median", "max", "min", "whole_min"])
def test_square_neighbourhoods_of_any_radius(spark, kind):
    from terradelta.operators import focal

    rng = random.Random(5)
    n = 30
    cells = {(s, r, c): rng.choice([0.0, 1.0, 2.5, -3.0, None, rng.random()]) for s in range(2) for r in range(n) for c in range(n) if rng.random() < 0.8}
    px = spark.createDataFrame([(*k, v) for k, v in cells.items()], "s long, r int, c int, v double")
    for radius, tile in ((1, 8), (5, 8), (25, 64)):
        got = {(x["s"], x["r"], x["c"]): x["v"] for x in focal.square(px, ["s"], "v", radius, kind, tile=tile).collect()}
        assert set(got) == set(cells)
        for s, r, c in rng.sample(sorted(cells), 120):
            near = [cells[s, y, x] for y in range(r - radius, r + radius + 1) for x in range(c - radius, c + radius + 1) if cells.get((s, y, x)) is not None]
            full = len(near) == (2 * radius + 1) ** 2
            want = {"mean": lambda v: sum(v) / len(v), "median": lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2, "max": max, "min": min, "whole_min": lambda v: min(v) if full else 0.0}[kind]  # noqa: B023
            expected = want(near) if near else (0.0 if kind == "whole_min" else None)
            assert got[s, r, c] == expected or abs(got[s, r, c] - expected) < 1e-9, (radius, s, r, c)


def test_rings_meet_by_edges_or_containment(spark):
    from terradelta.functions import geometry as G

    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    ell = [(0.0, 0.0), (10.0, 0.0), (10.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    others = [(box(5.0, 5.0, 3.0), False), (box(1.5, 5.0, 3.0), True), (box(0.5, 0.5, 0.5), True), (box(-5.0, -5.0, 30.0), True), (box(2.0, 2.0, 1.0), True), (box(10.0, 2.0, 1.0), True), (box(10.1, 0.0, 1.0), False), (box(2.5, 2.5, 20.0), False)]
    shape = "array<struct<x:double,y:double>>"
    as_rows = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    df = spark.createDataFrame([(k, as_rows(ell), as_rows(o)) for k, (o, _) in enumerate(others)], f"k int, a {shape}, b {shape}")
    got = df.select("k", G.rings_meet(F.col("a"), F.col("b")).alias("m"), G.rings_meet(F.col("b"), F.col("a")).alias("w")).orderBy("k").collect()
    assert [r["m"] for r in got] == [r["w"] for r in got] == [m for _, m in others]


def test_clipped_rings_have_the_area_of_their_pixels(spark):
    from terradelta.functions import geometry as G

    rng = random.Random(11)
    shape = "array<struct<x:double,y:double>>"
    stars = [star(rng, rng.uniform(0, 10), rng.uniform(0, 10), 6, 7) for _ in range(12)]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in [*ring, ring[0]]]) for k, ring in enumerate(stars)], f"k int, ring {shape}")
    cut = df.select("k", G.clip_ring(F.col("ring"), F.lit(2.0), F.lit(3.0), F.lit(8.0), F.lit(9.0)).alias("ring")).select("k", G.ring_area(F.col("ring")).alias("area"), "ring")
    n = 120
    for row in cut.collect():
        pixels = sum(inside([stars[row["k"]]], 2 + (c + 0.5) * 6 / n, 3 + (r + 0.5) * 6 / n) for r in range(n) for c in range(n)) * (6 / n) ** 2
        assert abs((row["area"] or 0.0) - pixels) < 0.6
        assert all(1.999 < p["x"] < 8.001 and 2.999 < p["y"] < 9.001 for p in row["ring"] or [])
    away = df.select(G.clip_ring(F.col("ring"), *[F.lit(float(v)) for v in (100, 100, 101, 101)]).alias("ring"))
    assert away.where("ring IS NOT NULL").count() == 0


def test_a_window_reads_few_tiles_of_the_store(spark, tmp_path):
    from terradelta.sinks import writers
    from terradelta.sources import readers

    px = spark.createDataFrame([(s, r, c, float(r * 100 + c)) for s in range(2) for r in range(40) for c in range(40) if (r + c) % 3], "scene_id long, r long, c long, v double")
    writers.write_raster(px, f"{tmp_path}/t", "v", affine=writers.north_up(F.col("scene_id") * 10.0, F.lit(50.0), 2.0), crs="EPSG:1", tile=4)
    got = readers.read_raster(spark, f"{tmp_path}/t", 5, 9, 11, 3, tile=4)
    assert {(x["scene_id"], x["r"], x["c"], x["v"], x["affine"]["c"]) for x in got.collect()} == {(s, r, c, float(r * 100 + c), s * 10.0) for s in range(2) for r in range(5, 16) for c in range(9, 12) if (r + c) % 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(tile_y,1)" in plan and "LessThanOrEqual(z," in plan
    z = spark.createDataFrame([(y, x) for y in range(20) for x in (0, 1, 5, 300, 65535)], "y long, x long").select("y", "x", writers.morton(F.col("y"), F.col("x")).alias("z"))
    assert all(r["z"] == readers._z(r["y"], r["x"]) for r in z.collect())
