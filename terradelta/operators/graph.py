"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.checkpoints import cut


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): b is the least node that a reaches, for every a that is not itself the least; nodes are any sortable values.

    Large-star and small-star steps alternate until the links stop changing, in a number of rounds that grows with the
    logarithm of the largest component. Minima are combined before the shuffle; a round's links are checkpointed.
    """
    signature = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = cut(edges, estimate=False)
    before = signature(edges)  # links that are stars already take one round
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct(), estimate=False)
        now = signature(edges)
        if now == before:
            return edges
        before = now
