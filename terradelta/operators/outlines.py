"""Outlines of labelled regions: boundary edges and paths within tiles, rings by list ranking.

A tile has the pixels with a corner in it. A pixel's side is an edge if the pixel beyond it is not of its region; an edge
starts at a corner, and that corner's tile follows it: rings within it are done, and paths that leave it end there. Each path is then a node whose successor is the path that takes over in the next tile. Pointer doubling finds the
least path of each ring, and, with the ring cut there, each path's place in it, in a number of rounds that follows the
logarithm of the paths of a ring. So a coastline of millions of edges is a table of bounded paths in order, not a row.
A region lies on the left of its edges as they are followed in (x to the right, y up); so outer rings turn
counter-clockwise and holes clockwise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradelta.checkpoints import cut
from terradelta.operators.tiles import map_tiles

#: Sides of a pixel as (row, column) of start and direction: lower side to the right, right side up, upper side to the left, left side down.
SIDES = [(1, 0, 0), (1, 1, 1), (0, 1, 2), (0, 0, 3)]
STEPS = [(0, 1), (-1, 0), (0, -1), (1, 0)]
#: The pixel beyond each side; a side's own pixel is on its left.
BEYOND = [(1, 0), (0, 1), (-1, 0), (0, -1)]
TILE = 256

RINGS = "array<array<struct<x:double,y:double>>>"


def boundary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, r, c, d: directed unit edges from grid point (r, c) in direction d."""
    sides = F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c"), F.lit(d).alias("d")) for a, b, d in SIDES])).alias("e")
    edges = labelled.select(*keys, "label", sides).select(*keys, "label", "e.*")
    # the same side seen from both pixels: right = left of the next column, lower = upper of the next row
    upright = F.col("d").isin(1, 3)
    at_r = F.when(F.col("d") == 1, F.col("r") - 1).otherwise(F.col("r"))
    at_c = F.when(F.col("d") == 2, F.col("c") - 1).otherwise(F.col("c"))
    same = edges.withColumn("_u", upright).withColumn("_r", at_r).withColumn("_c", at_c)
    one = same.groupBy(*keys, "label", "_u", "_r", "_c").agg(F.count("*").alias("_n"), F.min(F.struct("r", "c", "d")).alias("e"))
    return one.where("_n = 1").select(*keys, "label", "e.*")


def _follow(heads: list[int], own: list[int], after: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """(edges in order, path by path; the paths' sizes; whether they close) of edges each of which has one after it, or -1."""
    seen, order, sizes, closed = bytearray(len(after)), [], [], []
    for first in itertools.chain(heads, own):
        if seen[first]:
            continue
        at, begin = first, len(order)
        while at >= 0 and not seen[at]:
            seen[at] = 1
            order.append(at)
            at = after[at]
        sizes.append(len(order) - begin)
        closed.append(at >= 0)
    return order, sizes, closed


def _tracer(by: list[str], conn: int, tile: int):
    """Paths and links of tiles' pixels (by, tr, tc, r, c). Where two pixels meet at a corner only, a ring turns so that they
    are apart (4 neighbours) or together (8)."""

    def run(p: pa.Table, group: np.ndarray) -> pa.Table:
        # pixels in order of their place, with free rows and columns around each tile
        tr, tc, r, c = (p.column(k).to_numpy() for k in ("tr", "tc", "r", "c"))
        wide = tile + 3
        place = (group * wide + r - tr * tile + 2) * wide + c - tc * tile + 2
        row = np.argsort(place, kind="stable")
        place, group, tr, tc, r, c = (v[row] for v in (place, group, tr, tc, r, c))
        label, _ = pd.factorize(p.column("label").to_pandas())
        label, n = label[row], len(row)
        beside = {}  # the pixel of the same region at an offset, or -1
        for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)):
            k = np.minimum(np.searchsorted(place, place + a * wide + b), n - 1)
            hit = np.flatnonzero((place[k] == place + a * wide + b) & (label[k] == label))
            ahead, back = np.full(n, -1), np.full(n, -1)
            ahead[hit], back[k[hit]] = k[hit], hit
            beside[a, b], beside[-a, -b] = ahead, back
        # edges of pixel i in direction d are 4 i + d
        i = np.arange(n)
        edge, start_r, start_c, inside, ends, after = (np.zeros((n, 4), t) for t in (bool, np.int64, np.int64, bool, bool, np.int64))
        for a, b, d in SIDES:
            out, ahead = BEYOND[d], BEYOND[(d + 1) % 4]
            edge[:, d] = beside[out] < 0
            start_r[:, d], start_c[:, d] = r + a, c + b
            inside[:, d] = ((r + a) // tile == tr) & ((c + b) // tile == tc)
            ends[:, d] = ((r + a + STEPS[d][0]) // tile == tr) & ((c + b + STEPS[d][1]) // tile == tc)
            next_, across = beside[ahead], beside[out[0] + ahead[0], out[1] + ahead[1]]
            left, straight, right = i * 4 + (d + 1) % 4, next_ * 4 + d, across * 4 + (d + 3) % 4
            after[:, d] = np.where(next_ < 0, left, np.where(across < 0, straight, right)) if conn == 4 else np.where(across >= 0, right, np.where(next_ >= 0, straight, left))
        edge, start_r, start_c, inside, ends, after = (v.ravel() for v in (edge, start_r, start_c, inside, ends, after))
        name = (start_r << 33) + start_c * 4 + np.arange(4 * n) % 4
        whose = np.repeat(row, 4)
        own, links = np.flatnonzero(edge & inside), np.flatnonzero(edge & ~inside & ends)
        sort = lambda e: e[np.lexsort((name[e], label[e >> 2], group[e >> 2]))]
        own, heads = sort(own), sort(after[links])
        order, sizes, closed = _follow(heads.tolist(), own.tolist(), np.where(ends, after, -1).tolist())
        order, sizes, closed = np.array(order, np.int64), np.array(sizes, np.int64), np.array(closed, bool)
        final = np.cumsum(sizes) - 1
        first = order[final - sizes + 1]
        # the points where a path begins, turns and ends
        turns = np.ones(len(order), bool)
        turns[1:] = order[1:] % 4 != order[:-1] % 4
        turns[final - sizes + 1] = True
        path = np.repeat(np.arange(len(sizes)), sizes)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(path[turns], minlength=len(sizes)) + 1)])
        last, kept = order[final], order[turns]
        points = [np.empty(offsets[-1], np.int64) for _ in range(2)]
        step = np.array(STEPS)
        for k, start in enumerate((start_r, start_c)):
            points[k][np.arange(len(kept)) + path[turns]] = start[kept]
            points[k][offsets[1:] - 1] = start[last] + step[last % 4, k]
        no = len(links)
        pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([offsets, np.full(no, offsets[-1])]), pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in points], ["r", "c"]), mask=pa.array(np.arange(len(sizes) + no) >= len(sizes)))
        rows = p.select(by).take(pa.array(np.concatenate([whose[first], whose[links]])))
        found = {
            "first": pa.array(np.concatenate([name[first], name[after[links]]])),
            "last": pa.array(np.concatenate([name[last], name[links]]), mask=np.concatenate([closed, np.zeros(no, bool)])),
            "link": pa.array(np.arange(len(sizes) + no) >= len(sizes)),
            "points": pieces,
        }
        for k, v in found.items():
            rows = rows.append_column(k, v)
        return rows

    return run


def paths(labelled: DataFrame, keys: list[str], conn: int = 4, tile: int = TILE) -> DataFrame:
    """keys, label, ring, pos, points: pieces of rings, in order of pos within a ring; each piece begins where the one before
    it ends, and the last ends where the first begins. points: array of (r, c). A ring is named by its least piece."""
    by = [*keys, "label"]
    both = lambda v: F.array_distinct(F.array(F.floor(F.col(v) / tile), F.floor((F.col(v) + 1) / tile)))
    px = labelled.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    dealt = px.withColumn("tr", F.explode(both("r"))).withColumn("tc", F.explode(both("c")))
    fields = {f.name: f for f in dealt.schema.fields}
    schema = T.StructType([fields[k] for k in by]).add("first", T.LongType()).add("last", T.LongType()).add("link", T.BooleanType()).add("points", T._parse_datatype_string("array<struct<r:long,c:long>>"))
    traced = cut(map_tiles(dealt, [*keys, "tr", "tc"], _tracer(by, conn, tile), schema))
    closed = traced.where("NOT link AND last IS NULL").select(*by, F.col("first").alias("ring"), F.lit(0).cast("long").alias("pos"), "points")
    links = traced.where("link").select(*by, "last", F.col("first").alias("next"))
    open_ = traced.where("NOT link AND last IS NOT NULL").join(links, [*by, "last"]).select(*by, "first", "next", "points")
    nodes = cut(open_.select(*by, "first", "next"))
    rings = _ranked(_least(nodes, by), by)
    return closed.unionByName(open_.join(rings, [*by, "first"]).select(*by, "ring", "pos", "points"))


def _doubled(state: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    """Each node with what the node at its pointer holds, as (next2, carried2)."""
    ahead = state.select(*by, F.col("first").alias("next"), F.col("next").alias("next2"), *[F.col(c).alias(f"{c}2") for c in carried])
    return state.join(ahead, [*by, "next"], "left")


def _least(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, next, ring): the least node of each node's cycle. Once no minimum changes, each has seen its whole cycle."""
    state = nodes.withColumn("ring", F.col("first"))
    while True:
        both = _doubled(state, by, ["ring"])
        state = cut(both.select(*by, "first", F.col("next2").alias("next"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("moved")))
        if state.where("moved").isEmpty():
            return nodes.join(state.select(*by, "first", "ring"), [*by, "first"])
        state = state.drop("moved")


def _ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, ring, pos): places in each cycle from its least node on. Cycles are cut before that, and each node counts
    how many follow it."""
    state = cut(nodes.select(*by, "first", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("n")))
    while not state.where("next IS NOT NULL").isEmpty():
        both = _doubled(state, by, ["n"])
        state = cut(both.select(*by, "first", "ring", F.col("next2").alias("next"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
    return state.select(*by, "first", "ring", (-F.col("n")).alias("pos"))


def measures(pieces: DataFrame, keys: list[str], affine: tuple[float, float, float, float] = (1.0, 0.0, -1.0, 0.0)) -> DataFrame:
    """keys, label, area, perimeter, rings (their number): sums over pieces, so that none is put together. affine: x = a c + b,
    y = d r + e."""
    a, b, d, e = affine
    x, y = lambda p: p["c"] * F.lit(a) + F.lit(b), lambda p: p["r"] * F.lit(d) + F.lit(e)
    n = F.size("points")
    side = lambda p, q: F.struct((x(p) * y(q) - x(q) * y(p)).alias("cross"), F.sqrt((x(p) - x(q)) * (x(p) - x(q)) + (y(p) - y(q)) * (y(p) - y(q))).alias("length"))
    sides = F.zip_with(F.slice("points", F.lit(1), n - 1), F.slice("points", F.lit(2), n - 1), side)
    total = lambda c: F.aggregate("sides", F.lit(0.0), lambda s, v: s + v[c])
    each = pieces.withColumn("sides", sides).select(*keys, "label", "ring", (total("cross") / 2).alias("area"), total("length").alias("perimeter"))
    return each.groupBy(*keys, "label").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.count_distinct("ring").alias("rings"))


def joined(pieces: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """A closed ring from its pieces in order: corners only, from its least point on."""
    points = [p for piece in pieces for p in piece[:-1]]
    straight = lambda p, q, r: (p[0] == q[0] == r[0]) or (p[1] == q[1] == r[1])
    corners = [q for p, q, r in zip([points[-1], *points], points, [*points[1:], points[0]], strict=False) if not straight(p, q, r)]
    at = corners.index(min(corners))
    return [*corners[at:], *corners[: at + 1]]


def outlines(labelled: DataFrame, keys: list[str], affine: tuple[float, float, float, float] = (1.0, 0.0, -1.0, 0.0), conn: int = 4, pieces: DataFrame | None = None) -> DataFrame:
    """keys, label, rings: the outer ring and then the holes of each region, in the coordinates x = a c + b, y = d r + e of
    affine (a, b, d, e). A region's rings are values of its row, as in a feature; where that is too much, use ``paths``."""
    a, b, d, e = affine
    pieces = paths(labelled, keys, conn) if pieces is None else pieces
    each = pieces.groupBy(*keys, "label").agg(F.sort_array(F.collect_list(F.struct("ring", "pos", "points"))).alias("pieces"))
    schema = T.StructType([f for f in each.schema.fields if f.name != "pieces"]).add("rings", T._parse_datatype_string(RINGS))
    area = lambda ring: sum(p[1] * -q[0] + p[0] * q[1] for p, q in zip(ring, ring[1:], strict=False))  # noqa: E731  y is -r

    def rings(row: list) -> list[list[dict]]:
        parts: dict[int, list] = {}
        for piece in row:
            parts.setdefault(piece["ring"], []).append([(p["r"], p["c"]) for p in piece["points"]])
        return [[{"x": a * c + b, "y": d * r + e} for r, c in ring] for ring in sorted(map(joined, parts.values()), key=lambda ring: -area(ring))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield p.drop(columns="pieces").assign(rings=[rings(row) for row in p["pieces"]])

    return each.mapInPandas(run, schema)
