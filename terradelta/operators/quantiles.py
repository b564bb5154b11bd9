"""Exact quantiles of groups of any size by radix selection.

A group whose values fit in a task has its quantiles from one aggregate. For larger groups, values are counted in ``BINS``
equal bins between the group's ends (of magnitudes, as with a number's exponent, where the ends differ by more than two
doublings, else of values); a quantile lies in the bin in which its rank falls, and only rows of such bins are counted
again, between that bin's own ends, until few rows are left or all are equal. A round reads the rows once and keeps a count
for each bin; one or two rounds settle the exponent and five the rest of any double. Nothing but counts is brought together, so a scene of a billion values takes no more
memory than a small one, and the figures are those of interpolation between neighbouring ranks, the same as ``percentile``.

Values are finite; null and NaN ones are left out. A group without other values has a null array and a count of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.checkpoints import cut

#: So many groups, or ends of bins, are sent to the rows; more are joined by a shuffle.
SENT = 100_000
#: Groups, and what is left of larger ones, are ranked directly up to so many values.
SMALL = 200_000
BINS = 4096


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], small: int | None = None, bins: int = BINS) -> DataFrame:
    """(keys, n, q): the number of values of each group and its quantiles, an array in the order of ``shares``. Keys may have
    any names, as those of the columns in between, too; so they have names of their own until the end."""
    small = SMALL if small is None else small
    v = F.col(value).cast("double")
    names, keys = keys, [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(own) for k, own in zip(names, keys, strict=True)], F.when(~F.isnan(v), v).alias("_v"))
    sizes = cut(rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    wanted = F.array(*map(F.lit, shares))
    direct = lambda d: d.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile("_v", wanted).alias("q"))
    named = lambda d: d.select(*[F.col(own).alias(k) for k, own in zip(names, keys, strict=True)], "n", "q")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= small:
        return named(direct(rows))
    large = sizes.where(F.col("n") > small)
    few = direct(rows.join(_near(large.select(*keys)), keys, "left_anti"))
    return named(few.unionByName(_selected(rows.where("_v IS NOT NULL"), large, keys, shares, small, bins)))


def _magnitude(name: str) -> Column:
    """Grows with the value, by 1 where its size doubles."""
    v = F.col(name)
    return F.signum(v) * F.when(v == 0, 0.0).otherwise(F.log2(F.abs(v)) + 1075)


def _near(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT else table


def _selected(rows: DataFrame, large: DataFrame, keys: list[str], shares: list[float], small: int, bins: int) -> DataFrame:
    """The quantiles of groups (keys, n, lo, hi). A target is a rank, two of them for each share, and the ends between which
    its value lies, with the number of values below the lower one and between them."""
    at = lambda k, s: F.struct(F.lit(k).alias("_k"), (F.lit(s) * (F.col("n") - 1)).alias("_at"))
    placed = large.withColumn("_t", F.explode(F.array(*[at(k, s) for k, s in enumerate(shares)]))).select(*keys, "n", "_lo", "_hi", "_t.*")
    ends = placed.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).withColumn("_before", F.lit(0).cast("long")).withColumn("_inside", F.col("n"))
    targets = cut(ends)
    inner = [*keys, "_lo", "_hi"]
    while True:
        open_ = targets.where((F.col("_inside") > small) & (F.col("_lo") < F.col("_hi")))
        spans = open_.select(*inner).distinct()
        if spans.isEmpty():
            break
        wide = _magnitude("_hi") - _magnitude("_lo") > 2
        share = F.when(wide, (_magnitude("_v") - _magnitude("_lo")) / (_magnitude("_hi") - _magnitude("_lo"))).otherwise((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1).cast("long"))
        held = rows.join(_near(spans), keys).where("_v >= _lo AND _v <= _hi").groupBy(*inner, bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2"))
        run = held.withColumn("_below", F.sum("_c").over(Window.partitionBy(*inner).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_below", F.coalesce("_below", F.lit(0)))
        found = open_.join(run, inner).where((F.col("_rank") - F.col("_before") >= F.col("_below")) & (F.col("_rank") - F.col("_before") < F.col("_below") + F.col("_c")))
        narrowed = found.select(*keys, "n", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_k", "_at", "_rank", (F.col("_before") + F.col("_below")).alias("_before"), F.col("_c").alias("_inside"))
        targets = cut(targets.where((F.col("_inside") <= small) | (F.col("_lo") >= F.col("_hi"))).unionByName(narrowed))
    left = targets.where("_lo < _hi").select(*inner).distinct()
    sorted_ = rows.join(_near(left), keys).where("_v >= _lo AND _v <= _hi").groupBy(*inner).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    valued = targets.join(sorted_, inner, "left").withColumn("_value", F.coalesce(F.element_at("_all", (F.col("_rank") - F.col("_before") + 1).cast("int")), F.col("_lo")))
    low, high = F.min_by("_value", "_rank"), F.max_by("_value", "_rank")
    part = F.max("_at") - F.floor(F.max("_at"))
    each = valued.groupBy(*keys, "n", "_k").agg(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias("_value"))
    wide = each.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("_k", "_value"))).alias("q"))
    return wide.select(*keys, "n", F.transform("q", lambda x: x["_value"]).alias("q"))
