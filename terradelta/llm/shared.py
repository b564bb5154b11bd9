"""Joins with ids and with hot keys, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.checkpoints import cut, remove, shared_folder

__all__ = ["by_ids", "cut", "modest_batches", "remove", "salted_join", "shared_folder", "tidy", "without", "worker_state"]

#: Up to so many ids (8 bytes each) are sent to tasks; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: A key with more than one in so many of the rows is dealt to several tasks; there are at most so many such keys.
SHARES = 1000
#: Rows of a batch that Spark hands to Python; its own 10,000 whole texts take tens of MB, several times on either side.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_held: dict[str, object] = {}


def worker_state(owner: str, make: Callable[[], object] = dict) -> object:
    """What a Python worker keeps for one operator from task to task. Workers serve all operators in turn, so what another
    one kept is dropped first and the memory given back."""
    if owner not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[owner] = make()
    return _held[owner]


def give_back() -> None:
    """Free memory that Arrow's and the system's allocators hold goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives its task's memory back at the end, as its worker then stays idle beside others."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to ``BATCH_ROWS``. It stays so, as rows are made after their DataFrame was returned;
    no result depends on it, and a smaller setting is kept."""
    rows = int(spark.conf.get(_BATCH))
    if rows <= 0 or rows > BATCH_ROWS:  # none or less: no bound
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def by_ids(df: DataFrame, ids: DataFrame, how: str, *columns: str) -> DataFrame:
    """Join with a table of ids (``doc_id``, or these columns), without a shuffle of ``df`` while the ids are few (they are counted)."""
    ids = cut(ids)
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, list(columns) or ["doc_id"], how)


def without(df: DataFrame, gone: DataFrame, *key: Column) -> DataFrame:
    """The rows of ``df`` whose key, columns of ``df``, no row of ``gone`` has; whatever the columns' names are."""
    gone = cut(gone.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(gone.columns)]).alias("_gone")).distinct())
    own = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])
    return df.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, own == gone["_gone"], "left_anti")


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small``, whose keys are unique, that deals hot keys to several tasks.

    A key with more than one in ``SHARES`` of big's rows gets salts, one for each such share of the rows, rounded up to a
    power of two: big's rows take one by a hash of ``spread``, and small's row is repeated under each. Hot keys are at most
    ``SHARES`` and their salts at most twice as many, whatever the tables' sizes; so tasks get hashes of these keys as
    constants, and big's rows meet no other table. sizes: (key, n) of big's rows, where they are known already.
    """
    sizes = big.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    total = sizes.agg(F.sum("n")).first()[0] or 0
    power = F.ceil(F.log2(F.col("n") * SHARES / max(1, total)))
    levels: dict[int, list[int]] = {}
    for hashed, k in sizes.where(F.col("n") > max(1.0, total / SHARES)).select(F.xxhash64(key), power).collect():
        levels.setdefault(k, []).append(hashed)
    salts = F.lit(1)
    for k, hot in levels.items():  # at most ten
        salts = F.when(F.xxhash64(key).isin(hot), F.lit(1 << k)).otherwise(salts)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    return left.join(right, [key, "_salt"]).drop("_salt")
