"""Alerts: filters with drop counts, and figures of their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.operators.quantiles import quantiles


def stages(area_min: float | None = 400.0, prob_min: float | None = 0.3, only_restricted: bool = False) -> list[tuple[str, Column]]:
    """The conditions in their order; a null area or confidence counts as 0, and None asks for nothing."""
    at_least = lambda c, x: F.lit(True) if x is None else F.coalesce(c, F.lit(0.0)) >= x
    return [("area", at_least("area_m2", area_min)), ("mean_prob", at_least("mean_prob", prob_min)), ("restricted", F.coalesce("in_restricted_zone", F.lit(False)) if only_restricted else F.lit(True))]


def passing(alerts: DataFrame, **options) -> DataFrame:
    """The alerts (area_m2, mean_prob, in_restricted_zone, ...) that pass all stages."""
    for _, condition in stages(**options):
        alerts = alerts.where(condition)
    return alerts


def funnel(alerts: DataFrame, **options) -> DataFrame:
    """(step, stage, kept, dropped): how many alerts each stage leaves of those before it, by one aggregation."""
    steps = stages(**options)
    passed, sums = F.lit(True), [F.count("*").alias("k0")]
    for i, (_, condition) in enumerate(steps, 1):
        passed = passed & condition
        sums.append(F.count(F.when(passed, 1)).alias(f"k{i}"))
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"k{i}").alias("kept"), (F.col(f"k{i - 1}") - F.col(f"k{i}")).alias("dropped")) for i, (name, _) in enumerate(steps, 1)])
    return alerts.agg(*sums).select(F.inline(each))


def describe(alerts: DataFrame, value: str = "mean_prob") -> DataFrame:
    """n, mean, std, lo, q25, q50, q75, hi of the values that are not null: one row, quartiles by radix selection."""
    own = alerts.where(F.col(value).isNotNull()).select(F.lit(1).alias("_all"), F.col(value).alias("_value"))
    sums = own.groupBy("_all").agg(F.count("*").alias("n"), F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("std"), F.min("_value").alias("lo"), F.max("_value").alias("hi"))
    cuts = quantiles(own, ["_all"], "_value", [0.25, 0.5, 0.75]).select("_all", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))])
    return sums.join(cuts, "_all").select("n", "mean", "std", "lo", "q25", "q50", "q75", "hi")
