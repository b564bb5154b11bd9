"""Where users plug in their own code: row augmenters, scorers, metrics by name and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def augment(chips: DataFrame, fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shape: tuple[int, ...] = (4, 4, 4)) -> DataFrame:
    """Applies a function of both dates' arrays to each chip, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            both = [fn(np.array(a).reshape(shape), np.array(b).reshape(shape)) for a, b in zip(p["t0"], p["t1"], strict=True)]
            yield pd.DataFrame({"chip_id": p["chip_id"], "t0": [a.ravel() for a, _ in both], "t1": [b.ravel() for _, b in both]})

    made = chips.select("chip_id", "t0", "t1").mapInPandas(run, "chip_id long, t0 array<double>, t1 array<double>")
    kept = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(float("nan")))).alias(c)  # noqa: E731  pandas hands NaN over as null
    return made.select("chip_id", kept("t0"), kept("t1"))


def score(chips: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray], float]]) -> DataFrame:
    """Makes a scorer once per task and applies it to each chip."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for p in parts:
            yield pd.DataFrame({"chip_id": p["chip_id"], "score": [float(scorer(np.array(a), np.array(b))) for a, b in zip(p["t0"], p["t1"], strict=True)]})

    return chips.select("chip_id", "t0", "t1").mapInPandas(run, "chip_id long, score double")


class Metric:
    """A named aggregate column; metrics add up and scale like numbers."""

    def __init__(self, name: str, column: Column):
        self.name, self.column = name, column

    def __add__(self, other: Metric) -> Metric:
        return Metric(f"{self.name} + {other.name}", self.column + other.column)

    def __mul__(self, by: float) -> Metric:
        return Metric(f"{by} * {self.name}", self.column * by)

    __rmul__ = __mul__


#: Criteria by name: column builders of a probability and a target.
CRITERIA: dict[str, Callable[[Column, Column], Column]] = {
    "mse": lambda p, g: F.avg((p - g) * (p - g)),
    "l1": lambda p, g: F.avg(F.abs(p - g)),
    "dice": lambda p, g: 1 - 2 * F.sum(p * g) / F.greatest(F.sum(p) + F.sum(g), F.lit(1e-7)),
    "bce": lambda p, g: F.avg(-F.log(F.greatest(F.when(g == 1, p).otherwise(1 - p), F.lit(1e-7)))),
}


def criterion(name: str, p: Column, g: Column) -> Metric:
    if name not in CRITERIA:
        raise ValueError(f"no criterion {name!r}; there are {', '.join(sorted(CRITERIA))}")
    return Metric(name, CRITERIA[name](p, g))


def thresholded(p: Column, g: Column, threshold: float = 0.5, ignore: int | None = 255) -> list[Column]:
    """Aggregate columns tp, fp, fn of a thresholded prediction, for any groupBy."""
    use = F.lit(True) if ignore is None else g != ignore
    hard, pos = p >= threshold, g == 1
    return [F.count(F.when(use & c, 1)).alias(n) for n, c in (("tp", hard & pos), ("fp", hard & ~pos), ("fn", ~hard & pos))]


class Windows:
    """Rows (y, x) of the full windows of a raster."""

    def eval(self, width: int, height: int, size: int):
        for y in range(0, height - size + 1, size):
            for x in range(0, width - size + 1, size):
                yield y, x


def register_windows(spark, name: str = "tile_windows") -> None:
    """Makes the table function usable in SQL, also after LATERAL."""
    spark.udtf.register(name, udtf(Windows, returnType="y: int, x: int"))
