"""Which members of a large group of much alike sets may be similar, by what each has apart from the group's centre.

Versions of one page that are almost, but not quite, similar enough share nearly all of their shingles, so a filter on
common shingles lets all pairs pass. So each set is replaced by its difference from a centre: the shingles that more than
half of some members have. The difference of two sets is that of their differences. With D(x) the size of x's difference
and |x| that of its set, x and y are similar only if their differences have

    (E(x) + E(y)) / 2 shingles in common at least, where E(x) = D(x) - (100 - percent) / (100 + percent) * |x|,

and are surely similar if E(x) + E(y) is 0 or less. The sure pairs hang together by links with the member of least E.
For all others a prefix filter works on the differences: of two sets that need c common shingles, each puts its D - c + 1
first ones, seldom ones before frequent ones, in buckets, and similar sets meet in one. As c depends on both sets, members
go by levels of E, and a bucket is for a pair of levels, with the least E of the other level.

Any centre and any order of shingles give the same pairs, so both are taken from about ``DRAWN`` members of a group;
that bounds their size and changes only how many sets meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm import shingles as S
from terradelta.llm.shared import cut, salted_join

#: About so many members of a group give its centre and the order of its shingles.
DRAWN = 128


def _centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(region, shingle, times): parallel arrays of the shingles that several of a region's drawn members have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for region, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = np.frombuffer(items.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), region)), pa.array(values)], ["region", "shingle"])

    drawn = members.where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / DRAWN)) == 0).join(sets, "id").select("region", "items")
    counts = drawn.mapInArrow(run, "region long, shingle long").groupBy("region", "shingle").agg(F.count("*").cast("int").alias("times"))
    listed = counts.where("times > 1").groupBy("region").agg(F.collect_list(F.struct("shingle", "times")).alias("all"))
    return listed.select("region", F.col("all.shingle").alias("shingle"), F.col("all.times").alias("times"))


def _differences(members: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(id, region, component, excess, level, apart): each member's difference from its region's centre, seldom shingles
    first, and 100 + percent times its E."""
    known = sizes.select("region").join(_centres(members, sets), "region", "left")
    rows = salted_join(members.select("id", "region", "component"), known, "region", "id", sizes).join(sets, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                last, apart, excess = None, [], []
                for region, shingle, times, items in zip(b.column(1).to_pylist(), b.column(3), b.column(4), b.column(5), strict=True):
                    if region != last:
                        last, seen, often = region, np.zeros(0, np.uint64), np.zeros(0, np.int32)
                        if shingle.is_valid:
                            seen, often = shingle.values.to_numpy().view(np.uint64), times.values.to_numpy()
                            order = np.argsort(seen)
                            seen, often = seen[order], often[order]
                        centre = seen[2 * often > often.max(initial=0)]
                    own = np.frombuffer(items.as_buffer(), np.uint64)
                    differ = np.setxor1d(own, centre, assume_unique=True)
                    where = np.minimum(np.searchsorted(seen, differ), max(len(seen) - 1, 0))
                    # A shingle of the centre counts by the members that lack it.
                    count = np.where(seen[where] == differ, often[where], 0) if len(seen) else np.zeros(len(differ), np.int32)
                    count = np.minimum(count, often.max(initial=0) - count)
                    apart.append(differ[np.argsort(count, kind="stable")].tobytes())
                    excess.append(len(differ) * (100 + percent) - len(own) * (100 - percent))
                e = np.array(excess, np.int64)
                level = np.sign(e) * np.floor(3 * np.log2(1 + np.abs(e) / (100 + percent))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(e), pa.array(level.astype(np.int32)), pa.array(apart, pa.binary())], ["id", "region", "component", "excess", "level", "apart"])

    columns = rows.select("id", "region", "component", "shingle", "times", "items")
    return columns.mapInArrow(run, "id long, region long, component long, excess long, level int, apart binary")


def meetings(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, id, component), in whose buckets all similar members of different components meet but the sure ones, and
    (a, b), links that join all sure ones.

    members: (id, component, region, n) of regions with n members; sets: (id, items), as of ``shingle_sets``.
    """
    sizes = members.groupBy("region").agg(F.count("*").alias("n"))
    apart = cut(_differences(members, sets, cut(sizes), percent))
    levels = apart.groupBy("region", "level").agg(F.min("excess").alias("low"), F.max("excess").alias("high"), F.min(F.struct("excess", "id", "component")).alias("least"), F.count("*").alias("n"))
    listed = cut(levels.groupBy("region").agg(F.collect_list(F.struct("level", "low", "high")).alias("levels"), F.min("least").alias("least"), F.sum("n").alias("n")))
    rows = salted_join(apart, listed.drop("n"), "region", "id", listed.select("region", "n"))
    sure = rows.where("excess + least.excess <= 0 AND component <> least.component")
    links = sure.select(F.least("id", "least.id").alias("a"), F.greatest("id", "least.id").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                ids, region, component, excess, level, apart_of, levels_of = (b.column(k) for k in range(7))
                keys, taken = [], []
                plain = zip(region.to_pylist(), excess.to_pylist(), level.to_pylist(), apart_of, levels_of.to_pylist(), strict=True)
                for place, e, mine, items, others in ((r, *rest) for r, *rest in plain):
                    own = np.frombuffer(items.as_buffer(), np.uint64)
                    total = 0
                    for other in others:
                        if e + other["high"] <= 0:
                            continue
                        common = max(1, -(-(e + other["low"]) // (2 * (100 + percent))))
                        first = own[: max(0, len(own) - common + 1)]
                        one, two = sorted((mine, other["level"]))
                        salt = np.uint64((place * 1_000_003 + one * 4099 + two) % (1 << 64))
                        keys.append(S.mix(first ^ S.mix(np.array([salt]))))
                        total += len(first)
                    taken.append(total)
                rows = np.repeat(np.arange(b.num_rows), taken)
                key = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
                for lo in range(0, len(key), 1 << 16):
                    use = pa.array(rows[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), ids.take(use), component.take(use)], ["bucket", "id", "component"])

    return rows.select("id", "region", "component", "excess", "level", "apart", "levels").mapInArrow(run, "bucket long, id long, component long"), links
