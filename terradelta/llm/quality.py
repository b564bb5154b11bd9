"""Quality classification by co-training of a text view and a page-metadata view.

Two logistic models see different things: the text model hashed words and how often they repeat at once, the metadata model what is said about the page and
how it is laid out: its source and declared language (hashed by CRC-32), its declared length in characters, and figures
of its layout (bytes, lines, bytes a word, shares of capitals, digits and signs), but no word.
Both first learn from the labelled documents alone. Then, for ``ROUNDS`` rounds, each model labels the unlabelled documents that it is most sure of, and
these pseudo-labels join the *other* model's training set. At the end each view is calibrated on labelled documents kept
out of training (a Platt fit), and a document's score is the mean of both calibrated log-odds, as a probability of good
quality.

The labelled documents that models learn from are bounded: at most ``SAMPLE_LABELLED``, chosen by a hash of the doc_id,
and they stay on the driver. The unlabelled documents are not sampled: every row without a label is in the pool, its
views in a table of the shared folder. In each round tasks score the whole pool, the cuts are quantiles from histograms of
the scores (``BINS`` bins; in the bin at the cut, a hash of the row decides), and L-BFGS fits both views at once from
losses and gradients that tasks sum, at most ``STEPS`` passes a round. A pseudo-label weighs half a label, and those of one
class together no more than its labels, so that labels keep their say in a pool of any size. Every whole text is scored.

Null and empty texts have no words and the metadata of an empty page; they are scored like any other. Labels with a null
quality or a doc_id that no document has are not used; of several labels for one doc_id the lowest counts. Rows that
repeat a doc_id give a row each; in the pool too. Without labels of both kinds every score is 0.5. Where a
table has no column source, lang or n_chars, it counts as null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm import shingles as S
from terradelta.llm.shared import by_ids, remove, shared_folder

SAMPLE_LABELLED = 2000
ROUNDS, EXCHANGE = 4, 0.1
STEPS, TOLERANCE, DECAY = 15, 1e-4, 1e-5
BINS, REACH = 1 << 14, 16.0
#: Words of documents that a task works on at a time, and sums that a pass sends to the driver at least.
PART_WORDS, SUMS = 1 << 20, 64
WORDS, SOURCES, LANGUAGES = 1 << 14, 64, 16
KEEP = 0.5

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 97:123] = True
_CLASS[2, 48:58] = True
_CLASS[3, [9, 10, 11, 12, 13, 32]] = True
_CLASS[4, 10] = True
_CLASS[5] = ~(_CLASS[:4].any(0)) & (np.arange(256) < 128)
_KIND = np.full(256, 6, np.uint8)
for _k in (0, 1, 2, 3, 5):
    _KIND[_CLASS[_k]] = _k
FIGURES = 12
METADATA = FIGURES + SOURCES + LANGUAGES


def text_view(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its buckets of hashed words and their weights, log-damped and of length 1; and in bucket 0, the share
    of its words that one of the three words before them equals."""
    h, w = S.words(data, at)
    bucket = (h >> np.uint64(40)).astype(np.int64) % (WORDS - 1) + 1
    again = np.zeros(len(h), bool)
    place = np.arange(len(h)) - np.repeat(w[:-1], np.diff(w))
    for back in (1, 2, 3):
        again[back:] |= (h[back:] == h[:-back]) & (place[back:] >= back)
    out = []
    for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
        own, n = np.unique(bucket[a:b], return_counts=True)
        weight = np.log1p(n)
        weight /= max(1e-9, float(np.sqrt((weight**2).sum())))
        if repeats := int(np.count_nonzero(again[a:b])):
            own, weight = np.append(0, own), np.append(repeats / (b - a), weight)
        out.append((own, weight))
    return out


def metadata_view(data: np.ndarray, at: np.ndarray, sources: list[str | None], langs: list[str | None], lengths: list[int | None]) -> np.ndarray:
    """Of each text: figures of its layout, its declared length, and the buckets of its source and language."""
    n = np.diff(at)
    kind = _KIND[data]
    doc = np.repeat(np.arange(len(n)), n)
    share = np.bincount(doc * 8 + kind, minlength=8 * len(n)).reshape(-1, 8)[:, :7] / np.maximum(1, n)[:, None]
    lines = np.bincount(doc[data == 10], minlength=len(n))
    _, w = S.words(data, at)
    words = np.diff(w)
    out = np.zeros((len(n), METADATA))
    out[:, 0] = np.log1p(n) / 10
    out[:, 1:7] = share[:, [0, 1, 2, 3, 5, 6]]
    out[:, 7] = np.log1p(lines) / 10
    out[:, 8] = np.minimum(n / np.maximum(1, words), 1000) / 10
    out[:, 9] = 1
    for i, (source, lang, length) in enumerate(zip(sources, langs, lengths, strict=True)):
        if length is not None:
            out[i, 10] = np.log1p(max(0, length)) / 10
            out[i, 11] = 1
        if source is not None:
            out[i, FIGURES + zlib.crc32(source.encode("utf-8")) % SOURCES] = 1
        if lang is not None:
            out[i, FIGURES + SOURCES + zlib.crc32(lang.encode("utf-8")) % LANGUAGES] = 1
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logistic(x, y: np.ndarray, weight: np.ndarray, width: int, steps: int = 300, rate: float = 0.5, decay: float = DECAY) -> np.ndarray:
    """Weights of a logistic model by Adagrad. x: dense rows, or (row, column, value) of a sparse matrix."""
    theta, seen = np.zeros(width), np.full(width, 1e-8)
    for _ in range(steps):
        if isinstance(x, tuple):
            r, c, v = x
            z = np.bincount(r, v * theta[c], len(y))
            g = np.bincount(c, v * (weight * (_sigmoid(z) - y))[r], width)
        else:
            g = x.T @ (weight * (_sigmoid(x @ theta) - y))
        g = g / weight.sum() + decay * theta
        seen += g * g
        theta -= rate * g / np.sqrt(seen)
    return theta


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn a view's output into log-odds, fitted by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a), float(b)


class CoTrained:
    """Weights of the text view with a last one for the bias, of the metadata view, and their calibrations."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, calibration: list[tuple[float, float]]):
        self.text, self.meta, self.calibration = text.astype(np.float32), meta, calibration

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]], meta: np.ndarray) -> np.ndarray:
        z = np.array([float((self.text[c] * v).sum() + self.text[-1]) for c, v in texts])
        (a, b), (c, d) = self.calibration
        return _sigmoid(((a * z + b) + (c * (meta @ self.meta) + d)) / 2)


@dataclass
class _Part:
    """Both views of some documents, a hash below 1 of each, and the label that each view learns from: 0, 1, or -1 for none."""

    at: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    meta: np.ndarray
    chance: np.ndarray
    given: np.ndarray

    @classmethod
    def of(cls, texts: list[tuple[np.ndarray, np.ndarray]], meta: np.ndarray, given: np.ndarray) -> _Part:
        at = np.concatenate([[0], np.cumsum([len(c) for c, _ in texts], dtype=np.int64)])
        join = lambda xs: np.concatenate([*xs, np.zeros(0)])
        chance = (np.arange(len(texts)) * 2654435761 % (1 << 30)) / (1 << 30)
        return cls(at, join([c for c, _ in texts]).astype(np.int64), join([v for _, v in texts]), meta, chance, np.stack([given, given]))

    def outputs(self, models: list[np.ndarray]) -> list[np.ndarray]:
        n = len(self.meta)
        row = np.repeat(np.arange(n), np.diff(self.at))
        return [np.bincount(row, self.weights * models[0][self.words], n) + models[0][-1], self.meta @ models[1]]

    def histograms(self, models: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount(_bins(z), minlength=BINS) for z in self.outputs(models)])

    def marked(self, models: list[np.ndarray], cuts: list[tuple]) -> np.ndarray:
        """given, after what each view is most sure of has become the other's."""
        given = self.given.copy()
        for view, (z, (low, low_share, high, high_share)) in enumerate(zip(self.outputs(models), cuts, strict=True)):
            k = _bins(z)
            given[1 - view][(k < low) | ((k == low) & (self.chance < low_share))] = 0
            given[1 - view][(k > high) | ((k == high) & (1 - self.chance <= high_share))] = 1
        return given

    def sums(self, models: list[np.ndarray], weight: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """Of each view, the loss and its gradient over the documents it learns from. weight: [view, label]."""
        out = []
        for view in range(2):
            used = self.given[view] >= 0
            y, n = self.given[view][used], int(used.sum())
            if view == 0:
                size = np.diff(self.at)
                inside, row = np.repeat(used, size), np.repeat(np.arange(n), size[used])
                c, v = self.words[inside], self.weights[inside]
                z = np.bincount(row, v * models[0][c], n) + models[0][-1]
            else:
                z = self.meta[used] @ models[1]
            w = weight[view][y.astype(np.int64)]
            error = w * (_sigmoid(z) - y)
            g = np.append(np.bincount(c, v * error[row], WORDS), error.sum()) if view == 0 else self.meta[used].T @ error
            out.append((float((w * (np.logaddexp(0, z) - y * z)).sum()), g))
        return out

    def counts(self) -> np.ndarray:
        return np.array([[(g == y).sum() for y in (0, 1)] for g in self.given])


def _bins(z: np.ndarray) -> np.ndarray:
    """Bins of outputs, finest around 0."""
    return np.clip(((np.arcsinh(8 * z) / REACH + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _cuts(histogram: np.ndarray, low: int, high: int) -> tuple:
    """The bins at which the low least and the high greatest outputs end, each with the share of that bin that counts."""
    out = []
    for n, h in ((low, histogram), (high, histogram[::-1])):
        total = np.cumsum(h)
        k = int(np.searchsorted(total, n))
        out.append((k, float((n - (total[k] - h[k])) / h[k])))
    return *out[0], BINS - 1 - out[1][0], out[1][1]


class _Held:
    """A pool in memory."""

    def __init__(self, part: _Part):
        self.part, self.histograms, self.sums, self.counts = part, part.histograms, part.sums, part.counts

    def mark(self, models: list[np.ndarray], cuts: list[tuple]) -> None:
        self.part.given[:] = self.part.marked(models, cuts)

    def __len__(self) -> int:
        return len(self.part.meta)


class _Pool:
    """A pool in a table of the shared folder; a pass over it gives sums of its partitions' parts."""

    COLUMNS = "chance int, words binary, weights binary, meta binary, text_given byte, meta_given byte"

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.folder, self.k = f"{shared_folder(self.spark)}/quality-{uuid.uuid4().hex}", 0
        self._store(rows)
        self.size = self.rows.count()

    def _store(self, rows: DataFrame) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{self.k}")
        remove(self.spark, f"{self.folder}/{self.k - 1}")
        self.rows = self.spark.read.parquet(f"{self.folder}/{self.k}")
        self.k += 1

    def close(self) -> None:
        remove(self.spark, self.folder)

    def __len__(self) -> int:
        return self.size

    def _pass(self, of: Callable[[_Part], list[np.ndarray]]) -> list[np.ndarray]:
        """Arrays of all parts, summed in tasks and then here; their number follows the cores and not the table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for _, part in _parts(b):
                    found = of(part)
                    total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(x, np.float64).tobytes() for x in total]], pa.list_(pa.binary()))], ["sums"])

        some = self.rows.coalesce(max(SUMS, 2 * self.spark.sparkContext.defaultParallelism)).mapInArrow(run, "sums array<binary>").collect()
        return [sum(np.frombuffer(r["sums"][i], np.float64) for r in some) for i in range(len(some[0]["sums"]))]

    def histograms(self, models: list[np.ndarray]) -> np.ndarray:
        return np.stack(self._pass(lambda part: list(part.histograms(models)))).astype(np.int64)

    def sums(self, models: list[np.ndarray], weight: np.ndarray) -> list[tuple[float, np.ndarray]]:
        a, b, c, d = self._pass(lambda part: [x for view in part.sums(models, weight) for x in view])
        return [(float(a[0]), b), (float(c[0]), d)]

    def counts(self) -> np.ndarray:
        out = np.zeros((2, 2))
        for r in self.rows.groupBy("text_given", "meta_given").count().collect():  # nine rows at most
            for view, y in enumerate((r["text_given"], r["meta_given"])):
                if y >= 0:
                    out[view, y] += r["count"]
        return out

    def mark(self, models: list[np.ndarray], cuts: list[tuple]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece, part in _parts(b):
                    given = part.marked(models, cuts)
                    yield pa.RecordBatch.from_arrays([*piece.columns[:4], *(pa.array(g, pa.int8()) for g in given)], piece.schema.names)

        self._store(self.rows.mapInArrow(run, self.COLUMNS))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, _Part]]:
    """A batch of a pool's table in slices of about ``PART_WORDS`` words."""
    def cells(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        column = pa.concat_arrays([column.cast(pa.large_binary())])
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        return at, np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)

    if not batch.num_rows:
        return
    at, words = cells(batch.column(1), "<u2")
    _, weights = cells(batch.column(2), "<f4")
    _, meta = cells(batch.column(3), "<f4")
    meta, at = meta.reshape(-1, METADATA), (at - at[0]) // 2
    chance = batch.column(0).to_numpy(zero_copy_only=False) / (1 << 30)
    given = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)])
    lo = 0
    while lo < len(meta):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART_WORDS, "right")) - 1)
        some = slice(at[lo], at[hi])
        yield batch.slice(lo, hi - lo), _Part(at[lo : hi + 1] - at[lo], words[some].astype(np.int64), weights[some].astype(float), meta[lo:hi].astype(float), chance[lo:hi], given[:, lo:hi])
        lo = hi


class _Descent:
    """L-BFGS that is told the loss and gradient at ``at`` and moves it; ``best`` has the least loss so far."""

    def __init__(self, theta: np.ndarray):
        self.at, self.best, self.pairs, self.done = theta, None, [], False

    def told(self, loss: float, g: np.ndarray) -> None:
        if self.done:
            return
        if self.best is not None:
            if not loss <= self.best[1] + 1e-4 * self.step * self.slope:
                self.step *= 0.3
                self.done = self.step < 1e-4
                self.at = self.best[0] + self.step * self.way
                return
            self.done = self.best[1] - loss < TOLERANCE * loss
            s, y = self.at - self.best[0], g - self.best[2]
            if s @ y > 1e-12:
                self.pairs = [*self.pairs[-9:], (s, y)]
        self.best, q, kept = (self.at, loss, g), g.copy(), []
        for s, y in reversed(self.pairs):
            kept.append((s @ q) / (s @ y))
            q -= kept[-1] * y
        q *= (s_y := self.pairs[-1])[0] @ s_y[1] / (s_y[1] @ s_y[1]) if self.pairs else 2.0
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        self.way, self.slope, self.step = -q, -float(q @ g), 1.0
        self.at = self.best[0] + self.way


def _refit(models: list[np.ndarray], base: _Part, pool: _Held | _Pool) -> list[np.ndarray]:
    """Both views fitted to the labels and the pool's pseudo-labels, from where they are. Classes weigh the same."""
    labels, pseudo = base.counts(), pool.counts()
    part = np.minimum(0.5, labels / np.maximum(1, pseudo))
    weight = 0.5 / np.maximum(1, labels + part * pseudo)
    descents = [_Descent(m) for m in models]
    for _ in range(STEPS):
        now = [d.at for d in descents]
        for d, theta, (a, g), (b, h) in zip(descents, now, base.sums(now, weight), pool.sums(now, weight * part), strict=True):
            d.told(a + b + 0.5 * DECAY * float(theta @ theta), g + h + DECAY * theta)
        if all(d.done for d in descents):
            break
    return [d.best[0] for d in descents]


def _co_train(known: _Part, pool: _Held | _Pool, rounds: int, exchange: float) -> CoTrained | None:
    label = known.given[0]
    rows = np.arange(len(label))
    if len(set(label.tolist())) < 2:
        return None
    held = rows[::4] if len(set(label[::4].tolist())) == 2 else rows  # for calibration
    base = np.setdiff1d(rows, held) if len(held) < len(rows) else rows
    if len(set(label[base].tolist())) < 2:
        base = rows
    y = label[base]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    known.given = np.full((2, len(rows)), -1)
    known.given[:, base] = y
    row = np.repeat(np.arange(len(rows)), np.diff(known.at))
    inside = np.isin(row, base)
    bias = np.arange(len(base))
    sparse = (np.concatenate([np.searchsorted(base, row[inside]), bias]), np.append(known.words[inside], np.full(len(base), WORDS)), np.append(known.weights[inside], np.ones(len(base))))
    models = [_logistic(sparse, y, weight, WORDS + 1), _logistic(known.meta[base], y, weight, METADATA, steps=600)]
    good = float(np.clip((y == 1).mean(), 0.05, 0.95))
    for _ in range(rounds if len(pool) else 0):
        # what a view is sure of becomes the other's training data
        size = max(1, int(min(1.0, exchange) * len(pool)))
        low, high = max(1, int(size * (1 - good))), max(1, int(size * good))
        pool.mark(models, [_cuts(h, low, high) for h in pool.histograms(models)])
        models = _refit(models, known, pool)
        exchange *= 1.5
    return CoTrained(*models, [_platt(z[held], label[held]) for z in known.outputs(models)])


def co_train(texts: list, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, exchange: float = EXCHANGE) -> CoTrained | None:
    """In memory. label: 0, 1, or -1 for documents without one. None if a class has no label."""
    known, pool = (_Part.of([texts[i] for i in rows], meta[rows], label[rows]) for rows in (np.flatnonzero(label >= 0), np.flatnonzero(label < 0)))
    return _co_train(known, _Held(pool), rounds, exchange)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list, np.ndarray]]:
    """Rows and both views of a batch whose first columns are those of ``_page``."""
    for lo, hi, data, at in S.texts(batch.column(1)):
        yield lo, hi, text_view(data, at), metadata_view(data, at, *(batch.column(k).slice(lo, hi - lo).to_pylist() for k in (2, 3, 4)))


def _page(docs: DataFrame) -> list[Column]:
    """doc_id, text, source, lang, n_chars; null where the table lacks one of the last three."""
    declared = {"source": "string", "lang": "string", "n_chars": "long"}
    return [F.col("doc_id").cast("long"), F.col("text"), *((F.col(c) if c in docs.columns else F.lit(None)).try_cast(kind).alias(c) for c, kind in declared.items())]


def _sample(docs: DataFrame, n: int) -> DataFrame:
    """At most n rows, those of least hash; a bounded top-n, not a sort."""
    return docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def pool_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The views of every row of docs whose doc_id has no label."""

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts, meta in _views(b):
                cells = ([c.astype("<u2") for c, _ in texts], [v.astype("<f4") for _, v in texts], meta.astype("<f4"))
                none = pa.array(np.full(hi - lo, -1), pa.int8())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(5).slice(lo, hi - lo), *(pa.array([x.tobytes() for x in column], pa.binary()) for column in cells), none, none],
                    ["doc_id", "chance", "words", "weights", "meta", "text_given", "meta_given"],
                )

    rows = docs.select(*_page(docs), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("int").alias("chance"))
    return by_ids(rows.mapInArrow(views, f"doc_id long, {_Pool.COLUMNS}"), _valid(labels).select("doc_id"), "left_anti").drop("doc_id")


def _valid(labels: DataFrame) -> DataFrame:
    return labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = SAMPLE_LABELLED) -> CoTrained | None:
    chosen = _sample(docs.where("doc_id IS NOT NULL").select("doc_id").distinct().join(_valid(labels), "doc_id"), labelled)
    # The chosen ids are bounded by the sample size.
    some = docs.select(*_page(docs)).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts, meta in _views(b):
                y = b.column(5).slice(lo, hi - lo).cast(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), y, *(pa.array([x.tobytes() for x in column], pa.binary()) for column in ([c.astype("<i4") for c, _ in texts], [v.astype("<f4") for _, v in texts], meta))],
                    ["doc_id", "y", "words", "weights", "meta"],
                )

    rows = some.select("doc_id", "text", "source", "lang", "n_chars", "y").mapInArrow(views, "doc_id long, y int, words binary, weights binary, meta binary").toLocalIterator()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if len({r["y"] for r in rows}) < 2:
        return None
    texts = [(np.frombuffer(r["words"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(float)) for r in rows]
    meta = np.stack([np.frombuffer(r["meta"], np.float64) for r in rows])
    pool = _Pool(pool_rows(docs, labels))
    try:
        return _co_train(_Part.of(texts, meta, np.array([r["y"] for r in rows])), pool, ROUNDS, EXCHANGE)
    finally:
        pool.close()


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """doc_id, quality_score and keep of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("quality_score"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts, meta in _views(b):
                s = sent.value.score(texts, meta)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s, pa.float64()), pa.array(s >= KEEP)], ["doc_id", "quality_score", "keep"])

    return docs.select(*_page(docs)).mapInArrow(run, "doc_id long, quality_score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Co-trains on the labels and scores all documents."""
    return score(docs, train(docs, labels))
