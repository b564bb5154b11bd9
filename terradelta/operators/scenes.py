"""Scene catalogues and OSM extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.functions.geometry import bbox, rings_meet
from terradelta.operators import spatial as SJ


def search(items: DataFrame, start: str, end: str, cloud: float, collections: list[str], areas: DataFrame | None = None, key: str = "id", cell: float = SJ.CELL) -> DataFrame:
    """Items between two times, below a cloud cover, of some collections, and, with areas (a ring column), whose footprint
    (``ring``) meets one of them. The conditions on columns reach the scan where the items are read from files; boxes find
    the areas near a footprint, and rings decide. An item comes once, whatever it meets; items without a footprint go."""
    found = items.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (F.col("cloud") < cloud) & F.col("collection").isin(collections))
    if areas is None:
        return found
    boxed = lambda d: d.where("ring IS NOT NULL").withColumn("_box", bbox(F.col("ring"))).select("*", "_box.*").drop("_box")
    wanted = boxed(areas.select(F.monotonically_increasing_id().alias("_area"), "ring")).withColumnRenamed("ring", "_ring")
    met = SJ.box_pairs(boxed(found.select(key, "ring")), wanted, key, "_area", cell=cell, more=("_ring",)).where(rings_meet(F.col("ring"), F.col("_ring")))
    return found.join(met.select(key).distinct(), key, "left_semi")


def pair(items: DataFrame, targets: dict[str, str], days: int = 7, cloud: float = 30.0) -> DataFrame:
    """aoi_id and, for each named target date, the event_id of the AOI's least-cloud scene within some days of it (then the
    nearest, then the least id); AOIs that lack one go. All dates' winners come from one grouped pass."""
    day = F.to_date("datetime")
    dates = F.array(*[F.struct(F.lit(w).alias("which"), F.to_date(F.lit(d)).alias("target")) for w, d in targets.items()])
    near = items.where(F.col("cloud") < cloud).withColumn("t", F.explode(dates)).where(F.abs(F.datediff(day, F.col("t.target"))) <= days)
    best = F.min(F.struct("cloud", F.abs(F.datediff(day, F.col("t.target"))), "id", "event_id"))["event_id"]
    return near.groupBy("aoi_id").pivot("t.which", list(targets)).agg(best).dropna()


def months_apart(first, last):
    """Whole calendar months from one date to another."""
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)


def osm_ways(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """way_id, kind (polygon where a way of four points or more ends where it starts, else line) and its points in order.

    nodes: (node_id, x, y); ways: (way_id, nodes array). Nodes that the extract lacks are left out; ways of fewer than two
    points go. A way's points are values of its one row."""
    listed = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"))
    placed = listed.join(nodes, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    ends = [F.element_at("p", k) for k in (1, -1)]
    closed = (ends[0]["x"] == ends[1]["x"]) & (ends[0]["y"] == ends[1]["y"]) & (F.size("p") >= 4)
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return placed.where(F.size("p") >= 2).select("way_id", F.when(closed, "polygon").otherwise("line").alias("kind"), points.alias("points"))
