"""Reproducible splits and samples. Randomness is md5 of a seed and the key, so it is the same on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.checkpoints import cut


def shuffle_key(key: Column, seed: str = "42") -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary"))


def uniform(key: Column, seed: str = "42") -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def ranked(df: DataFrame, key: str, val: float, test: float, rounding: str = "round", seed: str = "42", ranks: int = 1024) -> DataFrame:
    """Splits by shuffled rank: the first n * val rows are val, the next n * test rows test.

    Ranks are computed in two steps, so that no task sorts all rows: the shuffle key's leading digits name a slice, each
    row is ranked within its slice, and the sizes of the earlier slices are added.
    """
    order = shuffle_key(F.col(key), seed)
    rows = df.withColumn("_o", order).withColumn("_s", F.conv(F.substring("_o", 1, 4), 16, 10).cast("int") % F.lit(65536) * ranks / 65536).withColumn("_s", F.floor("_s"))
    inside = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_o", key)))
    sizes = rows.groupBy("_s").agg(F.count("*").alias("_c"))  # at most ``ranks`` rows
    before = sizes.select("_s", (F.sum("_c").over(Window.orderBy("_s")) - F.col("_c")).alias("_b"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    size = {"round": lambda f: F.round(F.col("_n") * f), "floor": lambda f: F.floor(F.col("_n") * f), "least1": lambda f: F.greatest(F.lit(1), F.floor(F.col("_n") * f))}[rounding]
    rank = F.col("_r") + F.col("_b")
    split = F.when(rank <= size(val), "val").when(rank <= size(val) + (size(test) if test else 0), "test").otherwise("train")
    return inside.join(F.broadcast(before), "_s").withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def bernoulli(key: Column, train: float, val: float, seed: str = "42") -> Column:
    u = uniform(key, seed)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def stratified(df: DataFrame, key: str, positive: Column, n: int, seed: str = "42") -> DataFrame:
    """Moves up to n positive and n negative train rows to val."""
    train = F.col("split") == "train"
    order = Window.partitionBy(positive, train).orderBy(shuffle_key(F.col(key), seed), key)
    picked = df.where(train).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select(key, F.lit(True).alias("_p"))
    return df.join(picked, key, "left").withColumn("split", F.when(F.col("_p"), "val").otherwise(F.col("split"))).drop("_p")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: str = "42") -> DataFrame:
    """draw, key, weight of n seeded draws with replacement, each row as likely as its weight.

    Rows are summed within range slices of the key, and a draw finds its slice from the slices' sums, one row of as many
    numbers as there are slices; then it is compared with the rows of that slice only.
    """
    rows = cut(df.select(key, weight).repartitionByRange(key).withColumn("_s", F.spark_partition_id()))
    inside = rows.withColumn("_hi", F.sum(weight).over(Window.partitionBy("_s").orderBy(key)))
    sums = sorted(rows.groupBy("_s").agg(F.sum(weight)).collect())  # a row for each slice
    ends = [0.0]
    for _, w in sums:
        ends.append(ends[-1] + float(w))
    number = lambda x: F.array(*[F.lit(v) for v in x])
    k = F.size(F.filter(number(ends[1:]), lambda end: end <= F.col("_u") * ends[-1])) + 1
    drawn = df.sparkSession.range(n if sums else 0).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("_u"))
    placed = drawn.select("draw", F.element_at(number([s for s, _ in sums] or [0]), k).alias("_s"), (F.col("_u") * ends[-1] - F.element_at(number(ends), k)).alias("_at"))
    found = inside.join(placed, "_s").where((F.col("_at") >= F.col("_hi") - F.col(weight)) & (F.col("_at") < F.col("_hi")))
    return found.select("draw", key, weight)
