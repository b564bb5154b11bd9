"""Pairing and integrity of files: before, after and label images of a chip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.checkpoints import cut

TAGS = ["A", "B", "label"]


def triples(files: DataFrame, *keys: str) -> DataFrame:
    """One row per key with the first path of each tag, by one pivot and one shuffle."""
    return files.groupBy(*keys).pivot("tag", TAGS).agg(F.min("path"))


def complete(pivoted: DataFrame) -> DataFrame:
    return pivoted.dropna(subset=TAGS)


def incomplete(pivoted: DataFrame) -> DataFrame:
    return pivoted.where(F.expr("A IS NULL OR B IS NULL OR label IS NULL"))


def ranked(df: DataFrame, order: str, name: str, *part: str) -> DataFrame:
    """(part, name, k): ranks from 1 within a part. Rows are ranked within range slices, and the sizes of the part's earlier
    slices are added, so that no task sorts a whole part."""
    rows = cut(df.select(*part, F.col(order).alias(name)).repartitionByRange(*part, name).withColumn("_s", F.spark_partition_id()))
    inside = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*part, "_s").orderBy(name)))
    sizes = rows.groupBy(*part, "_s").agg(F.count("*").alias("_c"))  # a row for each slice of a part
    before = sizes.select(*[F.col(c).alias(f"_{c}") for c in part], F.col("_s").alias("_t"), (F.sum("_c").over(Window.partitionBy(*part).orderBy("_s")) - F.col("_c")).alias("_b"))
    same = (F.col("_s") == F.col("_t")) & F.expr(" AND ".join(["true", *(f"{c} <=> _{c}" for c in part)]))
    return inside.join(before, same).select(*part, name, (F.col("_r") + F.col("_b")).cast("int").alias("k"))


def positional(one: DataFrame, two: DataFrame, order: str, *part: str) -> DataFrame:
    """Joins two lists by their rank in sorted order within a part; a list that is longer leaves rows without partner."""
    return ranked(one, order, "a", *part).join(ranked(two, order, "b", *part), [*part, "k"], "full_outer")


def both_good(pairs: DataFrame, quality: DataFrame, least: float) -> DataFrame:
    """Pairs whose two files both have this valid_ratio; files that the summary lacks count as 0."""
    q = quality.select("name", "valid_ratio")
    a, b = q.select(F.col("name").alias("a_name"), F.col("valid_ratio").alias("qa")), q.select(F.col("name").alias("b_name"), F.col("valid_ratio").alias("qb"))
    out = pairs.join(a, "a_name", "left").join(b, "b_name", "left")
    good = lambda c: F.coalesce(F.col(c), F.lit(0.0)) >= least
    return out.where(good("qa") & good("qb"))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The first row with this key; an error if there is none."""
    row = df.where(F.col(key) == value).limit(1)
    if row.isEmpty():
        raise ValueError(f"no row with {key} = {value}")
    return row


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
