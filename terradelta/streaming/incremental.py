"""Incremental forms: scenes that arrive page by page, and a metrics log that is summed up as it grows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.checkpoints import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream over the event files of a folder."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that is there now, into a table; a second call with the same path goes on where this one stopped."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:  # each batch holds every row that changed; the last one of a key counts
        query = writer.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def ingest_scenes(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """The first arrival of each scene id; state is kept for as long as duplicates may be late."""
    scene = stream.select(F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("id"), "ts", "event_type")
    return scene.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def daily_metrics(stream: DataFrame) -> DataFrame:
    """Count and mean of a value per day."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", "2 days").groupBy(day).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.to_date("window.start").cast("string").alias("day"), "n", "mean")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
