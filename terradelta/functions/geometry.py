"""Geometry as column expressions: boxes, rings (arrays of x, y structs), affines, and UTM projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid and UTM scale (fixed values).
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed ring of a box."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def _edges(ring: Column) -> Column:
    """Edges as a.x, a.y, b.x, b.y with their cross product."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), (a["x"] * b["y"] - b["x"] * a["y"]).alias("cross")))


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    return _sum(_edges(ring), lambda e: e["cross"]) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid (x, y)."""
    edges, area = _edges(ring), signed_area(ring) * 6
    return point(_sum(edges, lambda e: (e["ax"] + e["bx"]) * e["cross"]) / area, _sum(edges, lambda e: (e["ay"] + e["by"]) * e["cross"]) / area)


def bbox(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def repair(ring: Column) -> Column:
    """Closes an open ring and turns a clockwise one; null where fewer than three corners are left."""
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(F.element_at(ring, 1))))
    return F.when((F.size(ring) >= 3) & (F.size(closed) >= 4), F.when(signed_area(closed) < 0, F.reverse(closed)).otherwise(closed))


def ring_length(ring: Column) -> Column:
    """Length of a closed ring or a line."""
    return _sum(_edges(ring), lambda e: F.sqrt(F.pow(e["bx"] - e["ax"], F.lit(2.0)) + F.pow(e["by"] - e["ay"], F.lit(2.0))))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """A point lies inside a closed ring: a ray to the right crosses its edges an odd number of times."""
    crosses = lambda e: (e["ay"] > y) != (e["by"] > y)
    right = lambda e: x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] == e["ay"], 1.0).otherwise(e["by"] - e["ay"]) + e["ax"]
    return F.size(F.filter(_edges(ring), lambda e: crosses(e) & right(e))) % 2 == 1


def rings_meet(a: Column, b: Column) -> Column:
    """Two closed rings' areas meet: edges cross or touch, or one ring lies in the other."""
    turn = lambda px, py, qx, qy, x, y: (qx - px) * (y - py) - (qy - py) * (x - px)

    def cross(e: Column, f: Column) -> Column:
        near = F.lit(True)
        for u, v in (("ax", "bx"), ("ay", "by")):
            near &= (F.greatest(e[u], e[v]) >= F.least(f[u], f[v])) & (F.greatest(f[u], f[v]) >= F.least(e[u], e[v]))
        apart = lambda g, h: turn(g["ax"], g["ay"], g["bx"], g["by"], h["ax"], h["ay"]) * turn(g["ax"], g["ay"], g["bx"], g["by"], h["bx"], h["by"])
        return near & (apart(e, f) <= 0) & (apart(f, e) <= 0)

    first = lambda ring: F.element_at(ring, 1)
    edges = _edges(b)
    return F.exists(_edges(a), lambda e: F.exists(edges, lambda f: cross(e, f))) | in_ring(a, first(b)["x"], first(b)["y"]) | in_ring(b, first(a)["x"], first(a)["y"])


def clip_ring(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The closed ring cut to a box: a fold over the box's half-planes, each of which cuts what the last one left; null where
    nothing is left. A ring in several pieces stays one ring, with edges of no area between them along the box."""
    ways = ((True, xmin, 1.0), (True, xmax, -1.0), (False, ymin, 1.0), (False, ymax, -1.0))
    planes = F.array(*[F.struct(F.lit(upright).alias("upright"), bound.cast("double").alias("bound"), F.lit(sign).alias("sign")) for upright, bound, sign in ways])
    none = F.array().cast("array<struct<x:double,y:double>>")

    def cut(points: Column, plane: Column) -> Column:
        depth = lambda p: (F.when(plane["upright"], p["x"]).otherwise(p["y"]) - plane["bound"]) * plane["sign"]

        def sent(a: Column, b: Column) -> Column:
            share = depth(a) / (depth(a) - depth(b))
            at = F.array(point(a["x"] + share * (b["x"] - a["x"]), a["y"] + share * (b["y"] - a["y"])))
            own, inside_a, inside_b = F.array(point(b["x"], b["y"])), depth(a) >= 0, depth(b) >= 0
            return F.when(inside_a & inside_b, own).when(inside_a, at).when(inside_b, F.concat(at, own)).otherwise(none)

        n = F.greatest(F.size(points) - 1, F.lit(0))
        kept = F.flatten(F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), sent))
        return F.get(F.transform(F.array(kept), _closed), F.lit(0))  # so that they are found once

    left = F.aggregate(planes, F.coalesce(ring.cast("array<struct<x:double,y:double>>"), none), cut)
    return F.when(F.size(left) > 0, left)


def clipped(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """(xmin, ymin, xmax, ymax, area) of ``clip_ring``; nulls where nothing is left. An upright rectangle is cut by its ends,
    without a fold over its corners; other rings are cut once, whatever is asked of them."""
    x, y = lambda k: F.get(ring, F.lit(k))["x"], lambda k: F.get(ring, F.lit(k))["y"]
    upright = (y(0) == y(1)) & (x(1) == x(2)) & (y(2) == y(3)) & (x(3) == x(0)) & (x(0) == x(4)) & (y(0) == y(4)) & (x(0) <= x(1)) & (y(1) <= y(2))
    ends = [f(own, bound.cast("double")) for f, own, bound in ((F.greatest, x(0), xmin), (F.greatest, y(0), ymin), (F.least, x(1), xmax), (F.least, y(2), ymax))]
    names = ("xmin", "ymin", "xmax", "ymax")
    box = F.struct(*[e.alias(n) for e, n in zip(ends, names, strict=True)], ((ends[2] - ends[0]) * (ends[3] - ends[1])).alias("area"))
    left = (ends[0] <= ends[2]) & (ends[1] <= ends[3])
    of = lambda r: F.struct(*[bbox(r)[n].alias(n) for n in names], ring_area(r).alias("area"))
    fold = F.get(F.transform(F.array(clip_ring(ring, xmin, ymin, xmax, ymax)), of), F.lit(0))
    return F.when((F.size(ring) == 5) & upright, F.when(left, box)).otherwise(fold)


def _closed(points: Column) -> Column:
    """The points after the last one of them."""
    return F.concat(F.slice(points, F.greatest(F.size(points), F.lit(1)), F.lit(1)), points)


def boxes_meet(a: str, b: str) -> Column:
    """Closed boxes of two aliases intersect."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "xmin") <= c(b, "xmax")) & (c(b, "xmin") <= c(a, "xmax")) & (c(a, "ymin") <= c(b, "ymax")) & (c(b, "ymin") <= c(a, "ymax"))


def segment_box_distance2(x1="x1", y1="y1", x2="x2", y2="y2") -> str:
    """Expression text: squared distance of a segment from a closed box xmin..ymax; 0 where they meet.

    A segment misses a box only if their spans along x, y or the segment's normal are apart; then the distance is the
    least from an end to the box or from a corner to the segment.
    """
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    end = lambda x, y: f"(power(greatest(xmin - {x}, 0, {x} - xmax), 2) + power(greatest(ymin - {y}, 0, {y} - ymax), 2))"
    along = lambda x, y: f"least(1.0, greatest(0.0, (({x} - {x1}) * {dx} + ({y} - {y1}) * {dy}) / greatest({dx} * {dx} + {dy} * {dy}, 1e-12)))"
    corner = lambda x, y: f"(power({x} - {x1} - {along(x, y)} * {dx}, 2) + power({y} - {y1} - {along(x, y)} * {dy}, 2))"
    side = lambda x, y: f"(({x} - {x1}) * {dy} - ({y} - {y1}) * {dx})"
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]
    sides = ", ".join(side(*c) for c in corners)
    meets = f"greatest({x1}, {x2}) >= xmin AND least({x1}, {x2}) <= xmax AND greatest({y1}, {y2}) >= ymin AND least({y1}, {y2}) <= ymax AND least({sides}) <= 0 AND greatest({sides}) >= 0"
    return f"CASE WHEN {meets} THEN 0.0 ELSE least({end(x1, y1)}, {end(x2, y2)}, {', '.join(corner(*c) for c in corners)}) END"


def utm_zone(lon: str) -> str:
    """Expression text: EPSG code of the northern UTM zone."""
    return f"(32600 + CAST(floor(({lon} + 180) / 6) AS BIGINT) + 1)"


def to_utm(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Expression texts of easting and northing by the transverse Mercator series; good to a millimetre within a zone."""
    phi, lam = f"radians({lat})", f"radians({lon} - ((({zone}) - 32600) * 6 - 183))"
    n = f"({A!r} / sqrt(1 - {E2!r} * power(sin({phi}), 2)))"
    t, c, a = f"power(tan({phi}), 2)", f"({EP2!r} * power(cos({phi}), 2))", f"(cos({phi}) * {lam})"
    x = f"({K0} * {n} * ({a} + (1 - {t} + {c}) * power({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * EP2!r}) * power({a}, 5) / 120) + 500000)"
    y = f"({K0} * ({_meridian(phi)} + {n} * tan({phi}) * (power({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * power({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * EP2!r}) * power({a}, 6) / 720)))"
    return x, y


def _meridian(phi: str) -> str:
    e2, e4, e6 = E2, E2**2, E2**3
    terms = (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024, 15 * e4 / 256 + 45 * e6 / 1024, 35 * e6 / 3072)
    return f"({A!r} * ({terms[0]!r} * {phi} - {terms[1]!r} * sin(2 * {phi}) + {terms[2]!r} * sin(4 * {phi}) - {terms[3]!r} * sin(6 * {phi})))"


def to_wgs84(x: str, y: str, zone: str) -> tuple[str, str]:
    """Expression texts of longitude and latitude, the inverse of ``to_utm``."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    mu = f"({y} / {K0 * A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256)!r})"
    phi = f"({mu} + {3 * e1 / 2 - 27 * e1**3 / 32!r} * sin(2 * {mu}) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r} * sin(4 * {mu}) + {151 * e1**3 / 96!r} * sin(6 * {mu}))"
    w = f"(1 - {E2!r} * power(sin({phi}), 2))"
    n, r = f"({A!r} / sqrt({w}))", f"({A * (1 - E2)!r} / power({w}, 1.5))"
    t, c, d = f"power(tan({phi}), 2)", f"({EP2!r} * power(cos({phi}), 2))", f"(({x} - 500000) / ({n} * {K0}))"
    lat = f"degrees({phi} - {n} * tan({phi}) / {r} * (power({d}, 2) / 2 - (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - {9 * EP2!r}) * power({d}, 4) / 24))"
    lon = f"((({zone}) - 32600) * 6 - 183 + degrees(({d} - (1 + 2 * {t} + {c}) * power({d}, 3) / 6 + (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + {8 * EP2!r} + 24 * {t} * {t}) * power({d}, 5) / 120) / cos({phi})))"
    return lon, lat
