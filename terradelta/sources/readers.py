"""Readers that give every layout of an input one schema. Paths are anything that Spark can read."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "struct<id:string,properties:struct<datetime:string,`eo:cloud_cover`:double>,assets:map<string,struct<href:string>>>"
SCENES = f"search_metadata struct<start:string>, items array<struct<collection:string,source_endpoint:string,item:{_ITEM}>>, collection string, source_endpoint string, item {_ITEM}"
OSM = "elements array<struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>>>"
_RINGS = "array<array<struct<x:double,y:double>>>"
HISTORY = "run string, history struct<epoch:array<bigint>,val_loss:array<double>,lr:array<double>>"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, if it has these columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_index(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return require(spark.read.parquet(path), *columns).select(*columns)


def read_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Chip-quality summary by file name, from CSV with a header in any order of columns: name, valid_ratio, finite_count."""
    raw = require(spark.read.csv(path, header=True), "name", "valid_ratio", "finite_count")
    return raw.select("name", F.col("valid_ratio").cast("double"), F.col("finite_count").cast("long"))


def read_scene_items(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Catalogue items of both layouts: documents that wrap a list of items, and bare items."""
    raw = spark.read.schema(SCENES).json(path, multiLine=multiline)
    wrapped = raw.where("items IS NOT NULL").select(F.explode("items").alias("i")).select("i.*")
    bare = raw.where("items IS NULL AND item IS NOT NULL").select("collection", "source_endpoint", "item")
    both = wrapped.unionByName(bare)
    hrefs = F.transform_values("item.assets", lambda k, v: v["href"])
    return both.select(F.col("item.id").alias("id"), "collection", "source_endpoint", F.col("item.properties.datetime").cast("timestamp").alias("datetime"), F.col("item.properties").getField("eo:cloud_cover").alias("cloud"), F.transform_keys(hrefs, lambda k, v: F.lower(k)).alias("assets"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollections, one document a file or a line: props (JSON text), geom_type, part, ring, holes.

    A MultiPolygon gives a row for each of its parts, with their numbers from 0; other geometries give one row. ring is the
    outer ring or the line, holes the rings inside it."""
    shape = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.text(path).select(F.from_json("value", shape).alias("d")).select(F.explode("d.features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygon = F.array(F.from_json(text, "array<array<array<double>>>"))
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    line = F.array(F.array(F.from_json(text, "array<array<double>>")))
    parts = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi).when(kind == "LineString", line)
    points = F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    rows = raw.select(F.col("f.properties").alias("props"), kind.alias("geom_type"), F.posexplode_outer(points).alias("part", "rings"))
    ring, holes = F.get("rings", F.lit(0)), F.filter("rings", lambda _, i: i > 0)
    return rows.select("props", "geom_type", F.coalesce("part", F.lit(0)).alias("part"), ring.alias("ring"), F.coalesce(holes, F.array().cast(_RINGS)).alias("holes"))


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat) and ways (id, nodes, tags)."""
    e = spark.read.schema(OSM).json(path).select(F.explode("elements").alias("e")).select("e.*")
    return e.where("type = 'node'").select("id", "lon", "lat"), e.where("type = 'way'").select("id", "nodes", "tags")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HISTORY).json(path)
    return raw.select("run", F.inline(F.arrays_zip("history.epoch", "history.val_loss", "history.lr")))


def read_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, dir, stem, ext, size of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("ext"), F.col("length").alias("size"))


def filter_by_list(df: DataFrame, path: str, column: str = "name") -> DataFrame:
    """Rows whose name a text file lists, one to a line."""
    names = df.sparkSession.read.text(path).select(F.trim("value").alias(column)).where(F.length(column) > 0).distinct()
    return df.join(names, column, "left_semi")


def encode_npy(df: DataFrame, key: str, values: str, shape: str) -> DataFrame:
    """(key, content): each row's array as the bytes of a .npy file of float32."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            raw = []
            for v, s in zip(p[values], p[shape], strict=True):
                np.save(out := io.BytesIO(), np.asarray(v, np.float32).reshape([int(x) for x in s]))
                raw.append(out.getvalue())
            yield pd.DataFrame({key: p[key], "content": raw})

    return df.select(key, values, shape).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def decode_npy(df: DataFrame, key: str) -> DataFrame:
    """(key, shape, dtype, values) of .npy contents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            arrays = [np.load(io.BytesIO(x), allow_pickle=False) for x in p["content"]]
            yield pd.DataFrame({key: p[key], "shape": [list(a.shape) for a in arrays], "dtype": [str(a.dtype) for a in arrays], "values": [a.astype(np.float32).ravel() for a in arrays]})

    made = df.select(key, "content").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, shape array<int>, dtype string, values array<float>")
    return made.withColumn("values", F.transform("values", lambda x: F.coalesce(x, F.lit(float("nan")).cast("float"))))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return decode_npy(spark.read.format("binaryFile").load(path).select("path", "content"), "path")


def read_raster(spark: SparkSession, path: str, y: int, x: int, height: int, width: int, tile: int = 32) -> DataFrame:
    """(scene_id, affine, crs, r, c, v) of the stored pixels of a window of every scene. Conditions on the tiles and on their
    places on the Z-order curve, between those of the window's corners, reach the files' statistics. tile: as written."""
    ends = {"tile_y": (y // tile, (y + height - 1) // tile), "tile_x": (x // tile, (x + width - 1) // tile)}
    found = spark.read.parquet(path)
    for name, (lo, hi) in ends.items():
        found = found.where((F.col(name) >= lo) & (F.col(name) <= hi))
    z = [_z(ends["tile_y"][k], ends["tile_x"][k]) for k in (0, 1)]
    cells = found.where((F.col("z") >= z[0]) & (F.col("z") <= z[1])).select(F.col("scene_id").cast("long").alias("scene_id"), "affine", "crs", F.inline("cells"))
    return cells.where((F.col("r") >= y) & (F.col("r") < y + height) & (F.col("c") >= x) & (F.col("c") < x + width))


def _z(y: int, x: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(16))


def rgb_arrays(images: DataFrame) -> DataFrame:
    """(origin, height, width, channels, values): images of Spark's image source with channels in RGB order, scaled to
    [0, 1]; a single channel stays single."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            values = []
            for h, w, n, raw in zip(p["height"], p["width"], p["channels"], p["data"], strict=True):
                a = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                a = a[:, :, 2::-1] if n >= 3 else a[:, :, :1]
                values.append((a / np.float32(255)).astype(np.float32).ravel())
            yield pd.DataFrame({"origin": p["origin"], "height": p["height"], "width": p["width"], "channels": p["channels"].clip(upper=3), "values": values})

    flat = images.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return flat.mapInPandas(run, "origin string, height int, width int, channels int, values array<float>")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return rgb_arrays(spark.read.format("image").load(path))
