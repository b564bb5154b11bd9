"""Writers. Each writes a new folder; none overwrites a path that the same plan reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.functions.geometry import to_wgs84


def write_index(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def _geometry(parts: str, zone: str | None) -> Column:
    """GeoJSON text of an array of polygons, each an array of rings, outer ring first: a Polygon or a MultiPolygon. zone: the
    UTM zone's EPSG code of the coordinates, which become longitude and latitude; None leaves them as they are."""
    x, y = ("p.x", "p.y") if zone is None else to_wgs84("p.x", "p.y", zone)
    placed = F.expr(f"transform({parts}, part -> transform(part, ring -> transform(ring, p -> array({x}, {y}))))")
    shape = lambda name, coordinates: F.to_json(F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates")))
    return F.when(F.size(parts) == 1, shape("Polygon", placed[0])).otherwise(shape("MultiPolygon", placed))


def write_geojson(df: DataFrame, path: str, parts: str, *props: str, zone: str | None = None) -> None:
    """Newline-delimited FeatureCollections of one feature, so that no task gathers a whole collection, and one that is
    empty, so that a table without rows gives a valid document too. parts: see ``_geometry``."""
    own = F.to_json(F.struct(*props)) if props else F.lit("{}")
    features = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), own, F.lit(',"geometry":'), _geometry(parts, zone), F.lit("}]}"))
    empty = df.sparkSession.range(1).select(F.lit('{"type":"FeatureCollection","features":[]}').alias("value"))
    df.select(features.alias("value")).unionByName(empty).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With header; maps, arrays and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("map", "array", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_arrays(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def _spread(v: Column) -> Column:
    """A 0 after each of a number's 16 bits."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(y: Column, x: Column) -> Column:
    """The place of a tile on the Z-order curve, on which tiles that are near are mostly near: the bits of y (below 2**16) and
    x in turn."""
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def write_raster(px: DataFrame, path: str, value: str, *, affine: Column, crs: str, tile: int = 32) -> None:
    """Tiles as sparse arrays of (r, c, v) with their place, a folder per scene, in Z-order, so that the files' statistics
    let a window be read without most of the others. affine: a struct (a, b, c, d, e, f) of each pixel's scene,
    x = a col + b row + c and y = d col + e row + f, see ``north_up``; crs: the coordinates' EPSG code."""
    cells = F.sort_array(F.collect_list(F.struct(F.col("r"), F.col("c"), F.col(value).alias("v"))))
    tiles = px.withColumn("affine", affine).groupBy("scene_id", "affine", F.floor(F.col("r") / tile).alias("tile_y"), F.floor(F.col("c") / tile).alias("tile_x")).agg(cells.alias("cells"))
    placed = tiles.withColumn("crs", F.lit(crs)).withColumn("tile", F.lit(tile)).withColumn("z", morton(F.col("tile_y"), F.col("tile_x")))
    placed.repartitionByRange("scene_id", "z").sortWithinPartitions("scene_id", "z").write.mode("overwrite").partitionBy("scene_id").parquet(path)


def north_up(x0: Column, y1: Column, res: float) -> Column:
    """The affine of a raster whose upper left corner lies at (x0, y1)."""
    values = {"a": F.lit(res), "b": F.lit(0.0), "c": x0, "d": F.lit(0.0), "e": F.lit(-res), "f": y1}
    return F.struct(*[v.cast("double").alias(k) for k, v in values.items()])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table does not hold; of rows that repeat a key one is taken. The first call makes the
    table; ``df`` must not read it. One writer at a time: a second one gets an error, as it would not see the first one's keys.
    A writer that died leaves the file ``<path>._appending``, which must be removed by hand."""
    spark = df.sparkSession
    place, lock = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}._appending"))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.createNewFile(lock):
        raise RuntimeError(f"another writer appends to {path}")
    try:
        new = df.dropDuplicates([key])
        if files.exists(place):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(df.columns)
        new.write.mode("append").parquet(path)
    finally:
        files.delete(lock, False)


def quarantine(df: DataFrame, bad: Column, good_path: str, bad_path: str) -> None:
    """Writes the bad rows (a null condition is good) to one table and all others to another."""
    is_bad = F.coalesce(bad, F.lit(False))
    df.where(is_bad).write.mode("overwrite").parquet(bad_path)
    df.where(~is_bad).write.mode("overwrite").parquet(good_path)
