"""Benchmark decontamination: which documents contain which test items.

An item is contained in a document if the document holds at least ``share`` of the item's distinct shingles of ``size``
words. An item of fewer words is one shingle, its whole sequence, which only an equal text has.

A MinHash signature of a long document says little about a short item in it: their Jaccard similarity is a fraction of a
percent. So the search works by containment: items are partitioned by the size of their sets, and each item is
represented by its bottom-k MinHash sketch, the k shingles of least hash, with k taken from the partition's upper size u
as floor((1 - share) * u) + 1. A document that holds a share of the item misses at most k - 1 of its shingles, so it
holds at least one of the sketch: no containment is missed, however long the document. Candidates are then verified by
exact counts over the item's full set.

The documents are read once. While all item sets together stay under ``ITEM_BYTES``, they travel to the tasks, which
probe and verify on the spot; beyond, sketches are joined with those of the documents' shingles that a filter of
``FILTER_BITS`` bits, sent to the tasks, lets pass, and only candidate pairs are joined with full sets.

Null and empty texts, of items or documents, contain nothing and are contained in nothing. Rows that repeat an item_id
are items of their own under one id, of which the best match counts; rows that repeat a doc_id give a pair once. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm import shingles as S
from terradelta.llm.shared import cut, tidy, worker_state

SIZE, SHARE = 5, 0.8
#: Item sets are sent to tasks only if they take no more than this together.
ITEM_BYTES = 32 << 20

#: Bits of the filter of sketches (8 MB).
FILTER_BITS = 1 << 26

_PAIR = "doc_id long, item_id long, n_common long, n_item long"


def sketch_size(n: int, share: float) -> int:
    """k for the size partition [2**p, 2**(p+1)) that n lies in."""
    upper = (1 << int(n).bit_length()) - 1
    return int((1 - share) * upper + 1e-9) + 1


def item_sets(items: DataFrame, size: int, share: float) -> DataFrame:
    """(item_id, items, sketch): the sorted shingle set of each item and its bottom-k sketch, 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                rows, sets, sketches = [], [], []
                for i, own in enumerate(S.distinct(*S.shingles(data, at, size))):
                    if len(own):
                        rows.append(lo + i)
                        sets.append(own.tobytes())
                        sketches.append(own[np.argsort(S.mix(own))[: sketch_size(len(own), share)]].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())], ["item_id", "items", "sketch"])

    return items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, items binary, sketch binary")


def _u64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


class _Index:
    """All items' sets, and their sketches' shingles sorted, for probing documents."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], share: float):
        self.share = share
        self.ids = [r[0] for r in rows]
        self.sets = [_u64(r[1]) for r in rows]
        keys = [_u64(r[2]) for r in rows]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def probe(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, shingles in common, item's shingles) of verified containments."""
        hit = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.keys, hashes[hit], "left")
        hi = np.searchsorted(self.keys, hashes[hit], "right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        doc = np.searchsorted(at, hit, "right") - 1
        for d in np.unique(doc):
            mine = doc == d
            owners = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo[mine], hi[mine], strict=True)]))
            own = np.sort(hashes[at[d] : at[d + 1]])
            for i in owners:
                s = self.sets[i]
                common = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if common >= self.share * len(s) - 1e-9:
                    yield int(d), self.ids[i], common, len(s)


def contained(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = SHARE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment) of every item contained in a document."""
    sets = cut(item_sets(items, size, share))
    total = sets.agg(F.sum(F.length("items") + F.length("sketch"))).first()[0] or 0
    found = _by_sent_items(docs, sets, size, share) if total <= item_bytes else _by_join(docs, sets, size, share)
    best = found.withColumn("containment", F.col("n_common") / F.col("n_item"))
    top = F.max(F.struct("containment", "n_item", "n_common"))
    return best.groupBy("doc_id", "item_id").agg(top.alias("top")).select("doc_id", "item_id", "top.n_common", "top.n_item", "top.containment")


def _by_sent_items(docs: DataFrame, sets: DataFrame, size: int, share: float) -> DataFrame:
    rows = [(r["item_id"], bytes(r["items"]), bytes(r["sketch"])) for r in sets.toLocalIterator()]  # at most ITEM_BYTES
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("items")
        index = _Index(sent.value, share)
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                found = list(index.probe(*S.shingles(data, at, size)))
                if found:
                    doc, item, common, n = zip(*found, strict=True)
                    ids = b.column(0).slice(lo, hi - lo).take(pa.array(doc, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (item, common, n))], ["doc_id", "item_id", "n_common", "n_item"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _PAIR)


def _sketch_filter(sets: DataFrame) -> np.ndarray:
    """A bit for each hash modulo ``FILTER_BITS``, set where some sketch has it. Four tasks' bits meet on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for x in b.column(0):
                bits[(_u64(x.as_py()) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    some = sets.select("sketch").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in some:
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits


def _by_join(docs: DataFrame, sets: DataFrame, size: int, share: float) -> DataFrame:
    """The same for any number of items: sketches join the documents' shingles, and candidates join both full sets."""
    sent = docs.sparkSession.sparkContext.broadcast(_sketch_filter(sets))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).view(bool)
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                own = [x[bits[(x & np.uint64(FILTER_BITS - 1)).astype(np.int64)]] for x in S.distinct(*S.shingles(data, at, size))]
                rows = np.repeat(np.arange(lo, hi), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["doc_id", "h"])

    def explode(column: str, owner: str):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                each = [_u64(x).astype(np.int64) for x in p[column]]
                yield pd.DataFrame({owner: np.repeat(p[owner].to_numpy(), [len(x) for x in each]), "h": np.concatenate(each) if each else np.zeros(0, np.int64)})

        return run

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                own = [x.tobytes() for x in S.distinct(*S.shingles(data, at, size))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], ["doc_id", "own"])

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            common = [len(np.intersect1d(_u64(a), _u64(b), assume_unique=True)) for a, b in zip(p["own"], p["items"], strict=True)]
            out = pd.DataFrame({"doc_id": p["doc_id"], "item_id": p["item_id"], "n_common": common, "n_item": p["items"].str.len() // 8})
            yield out[out["n_common"] >= share * out["n_item"] - 1e-9]

    numbered = cut(sets.withColumn("row", F.monotonically_increasing_id()))
    keys = numbered.select("row", "sketch").mapInPandas(explode("sketch", "row"), "row long, h long")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    texts = rows.mapInArrow(tidy(split), "doc_id long, own binary")
    held = rows.mapInArrow(tidy(likely), "doc_id long, h long")
    pairs = cut(held.join(keys, "h").select("doc_id", "row").distinct())
    full = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    return pairs.join(numbered.select("row", "item_id", "items"), "row").join(full, "doc_id").select("doc_id", "item_id", "own", "items").mapInPandas(verify, _PAIR)
