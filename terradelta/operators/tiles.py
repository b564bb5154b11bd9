"""Work on whole tiles of pixels, several in one call: a call for each tile costs more than small tiles' work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _groups(keys: pd.DataFrame) -> np.ndarray:
    """A number for each row of sorted keys, which grows where they change; nulls are equal."""
    before = keys.shift()
    changed = ((keys != before) & ~(keys.isna() & before.isna())).any(axis=1).to_numpy(bool)
    changed[:1] = False
    return np.cumsum(changed)


def map_tiles(df: DataFrame, by: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """The rows that ``run`` makes of the rows of whole tiles, those with equal values of ``by``, and of their tiles' numbers.
    A partition is read in order of its tiles, batch by batch; the rows of a tile that has not ended yet wait for the next."""
    names = [f.name for f in schema.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for p in parts:
            t = pa.Table.from_batches([p])
            t = t if held is None else pa.concat_tables([held, t])
            group = _groups(t.select(by).to_pandas())
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if whole:
                yield from run(t.slice(0, whole).combine_chunks(), group[:whole]).select(names).to_batches()
            held = t.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from run(held, _groups(held.select(by).to_pandas())).select(names).to_batches()

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(batches, schema)
