"""Language identification by a bidirectional GRU over bytes, trained here in numpy.

A text's UTF-8 bytes (A-Z as lower case) are read in both directions; the network labels every byte position, blanks,
digits and signs included, with language probabilities, and a document's probabilities are the mean over all positions of
its whole text. A text is read in spans of ``SPAN`` bytes side by side. Each span starts ``CONTEXT`` bytes before its first
position and ends as far after its last, so the states of both directions reach every labelled position having read what
is around it, across words, lines and spans; positions of the overlap are labelled once, in their own span. Spans are
sorted by length, so that each step works on those rows only that still have bytes. Gates are piecewise linear sigmoids.

Training is backpropagation through time with Adam on the driver, on a bounded sample of labelled documents: at most
``SAMPLE_DOCS`` for each language, chosen by a hash of the doc_id. Tasks draw ``WINDOWS`` windows of ``WINDOW`` bytes for
each language, evenly over all bytes of its sample, and only those come to the driver. Only texts and their languages are
seen; a prediction sees only the text. The languages, one row each, are known to the driver, as they are the outputs.

A network of known languages puts every text into one of them. So ``accept`` also asks whether a text looks like its
language at all: by the mean log-likelihood of its pairs of letters and blanks, as bytes, from the same windows. The floor
of each language is ``MARGIN`` bits a byte below what all but one in 200 documents of its sample reach, and lower for short
texts, whose mean varies; so texts of unknown languages and scripts, program code, encoded data and random letters go.

Null and empty texts and those without a letter are ``und`` with score 0. Documents with null lang are predicted but not
learned from; so are rows with a null doc_id. With no training document at all, all are ``und``, and ``accept`` has no
ground to reject any. Rows that repeat a doc_id give a row each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.llm.bpe import small
from terradelta.llm.shared import cut, worker_state

SAMPLE_DOCS = 500
SPAN, CONTEXT, ROWS = 232, 24, 2048
HIDDEN, STEPS, BATCH, WINDOW, WINDOWS = 12, 150, 192, 64, 8192
#: Bits a byte below a language's documents, and standard deviations of a short text's mean, that are still allowed; a text
#: with fewer pairs of letters and blanks is not judged by them.
MARGIN, DEVIATIONS, LEAST_PAIRS = 2.5, 3.0, 200
#: Bytes of a text that are rated at once.
PIECE = 1 << 15
UNKNOWN = "und"
#: A further floor, of the score, for ``accept``; a short text of a learned language may have any.
LEAST_SCORE = 0.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


#: Letters, blanks and all bytes of characters beyond ASCII, of folded bytes.
_WORDY = np.zeros(256, bool)
_WORDY[[9, 10, 13, 32, *range(97, 123), *range(128, 256)]] = True


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


class ByteGru:
    """Two gated recurrent layers over bytes, one from each side, and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.pairs = np.zeros((len(languages), 256, 256), np.float32)  # log2 of a byte's probability after another one
        self.floor, self.spread = np.full(len(languages), -np.inf), np.zeros(len(languages))
        self.p = {"out": draw(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": draw(256, 3 * hidden), f"h{way}": draw(hidden, 3 * hidden)}

    def _layer(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each position, [time, row, hidden]. keep: gets what the way back needs."""
        wx, wh, n = self.p[f"x{way}"], self.p[f"h{way}"], self.hidden
        h = np.zeros((x.shape[1], n), wx.dtype)
        out = np.zeros((*x.shape, n), wx.dtype)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a, b = wx[x[t]], h @ wh
            gates = _gate(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            after = np.where(mask[t][:, None], z * h + (1 - z) * new, h)
            if keep is not None:
                keep.append((t, h, z, r, new, b[:, 2 * n :]))
            out[t] = h = after
        return out

    def positions(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Language probabilities of each position, [time, row, language]."""
        states = np.concatenate([self._layer(w, x, mask, None if keep is None else keep.setdefault(w, [])) for w in "fb"], 2)
        if keep is not None:
            keep["states"] = states
        return _softmax(states @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions, by backpropagation through time. y: a language for each row."""
        keep: dict = {}
        d = self.positions(x, mask, keep)
        d[:, np.arange(len(y)), y] -= 1
        d *= (mask / mask.sum())[:, :, None]
        g = {"out": np.tensordot(keep["states"], d, ([0, 1], [0, 1])), "bias": d.sum((0, 1))}
        above, n = d @ self.p["out"].T, self.hidden
        for k, way in enumerate("fb"):
            wh = self.p[f"h{way}"]
            gx, gh = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(wh)
            seen, each = [], []
            carry = np.zeros((x.shape[1], n), wh.dtype)
            slope = lambda q: 0.2 * ((q > 0) & (q < 1))
            for t, h, z, r, new, inner in reversed(keep[way]):
                total = carry + above[t][:, k * n : (k + 1) * n]
                dh = np.where(mask[t][:, None], total, 0)
                dn = dh * (1 - z) * (1 - new * new)
                da = np.concatenate([dh * (h - new) * slope(z), dn * inner * slope(r), dn], 1)
                db = np.concatenate([da[:, : 2 * n], dn * r], 1)
                seen.append(x[t])
                each.append(da)
                gh += h.T @ db
                carry = np.where(mask[t][:, None], dh * z + db @ wh.T, total)
            seen = np.concatenate(seen)
            order = np.argsort(seen, kind="stable")
            values, first = np.unique(seen[order], return_index=True)
            gx[values] = np.add.reduceat(np.concatenate(each)[order], first, 0)
            g |= {f"x{way}": gx, f"h{way}": gh}
        return g

    def fit(self, windows: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """windows: of each language, drawn evenly over its bytes. Languages are drawn evenly."""
        rng = np.random.default_rng(seed)
        usable = np.array([k for k, own in enumerate(windows) if own])
        if not len(usable):
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            y = usable[rng.integers(0, len(usable), batch)]
            g = self.gradients(*padded([windows[k][int(rng.integers(0, len(windows[k])))] for k in y]), y)
            now = rate * (1 - step / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        for k, own in enumerate(windows):
            counts = np.full((256, 256), 0.02)
            for w in own:
                x = _FOLD[np.frombuffer(w, np.uint8)]
                np.add.at(counts, (x[:-1], x[1:]), 1)
            self.pairs[k] = np.log2(counts / counts.sum(1, keepdims=True))
        return self

    def familiarity(self, raw: bytes, language: int) -> tuple[float, float, int]:
        """Mean and deviation of the log2 probabilities of a text's letters and blanks after one another, and their number.
        The text is read in pieces, so that a long one needs no more memory than others."""
        table, total, squares, n = self.pairs[language].ravel(), 0.0, 0.0, 0
        data = np.frombuffer(raw, np.uint8)
        for lo in range(0, len(data) - 1, PIECE):
            x = _FOLD[data[lo : lo + PIECE + 1]]
            wordy = _WORDY[x]
            each = table[x[:-1].astype(np.int32) * 256 + x[1:]][wordy[:-1] & wordy[1:]]
            total += float(each.sum(dtype=np.float64))
            squares += float(np.square(each).sum(dtype=np.float64))
            n += len(each)
        return (total / n, max(0.0, squares / n - (total / n) ** 2) ** 0.5, n) if n else (0.0, 0.0, 0)

    def calibrate(self, seen: list[list[tuple[float, float]]]) -> ByteGru:
        """seen: of each language, its sample documents' familiarity."""
        for k, own in enumerate(seen):
            if own:
                self.floor[k] = np.quantile([mean for mean, _ in own], 0.005) - MARGIN
                self.spread[k] = np.median([deviation for _, deviation in own])
        return self

    def familiar(self, text: str, language: str) -> bool:
        k = self.languages.index(language)
        mean, _, n = self.familiarity(text.encode("utf-8"), k)
        return n < LEAST_PAIRS or mean >= self.floor[k] - DEVIATIONS * self.spread[k] / n**0.5

    def _parts(self, way: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """A layer's weights for each gate apart, with the gates' slope and middle taken in, and its share of the output."""
        n, k = self.hidden, "fb".index(way)
        x, h = np.split(self.p[f"x{way}"][_FOLD], 3, 1), np.split(self.p[f"h{way}"], 3, 1)
        scale = [np.float32(0.2), np.float32(0.2), np.float32(1)]
        xs = [np.ascontiguousarray(a * s + (np.float32(0.5) if i < 2 else 0), np.float32) for i, (a, s) in enumerate(zip(x, scale, strict=True))]
        return xs, [np.ascontiguousarray(a * s, np.float32) for a, s in zip(h, scale, strict=True)], np.ascontiguousarray(self.p["out"][k * n : (k + 1) * n], np.float32)

    def _outputs(self, way: str, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """A layer's share of the outputs of each step's active rows (the first ones), step by step."""
        xs, hs, out = self._parts(way)
        n = self.hidden
        h, (a, b, c, d) = np.zeros((x.shape[1], n), np.float32), (np.empty((x.shape[1], n), np.float32) for _ in range(4))
        found = np.empty((int(active.sum()), len(self.languages)), np.float32)
        at = 0
        for t, rows in enumerate(active.tolist()):
            i, now, z, r, inner, read = x[t, :rows], h[:rows], a[:rows], b[:rows], c[:rows], d[:rows]
            for gate, wx, wh in ((z, xs[0], hs[0]), (r, xs[1], hs[1])):
                np.matmul(now, wh, out=gate)
                gate += np.take(wx, i, 0, read, "clip")
                np.clip(gate, 0, 1, out=gate)
            np.matmul(now, hs[2], out=inner)
            inner *= r
            inner += np.take(xs[2], i, 0, read, "clip")
            np.tanh(inner, out=inner)
            now -= inner
            now *= z
            now += inner
            np.matmul(now, out, out=found[at : at + rows])
            at += rows
        return found

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: the probabilities summed over all its positions, [text, language]."""
        total = np.zeros((len(texts), len(self.languages)))
        spans = [(k, i) for k, t in enumerate(texts) for i in range(0, len(t), SPAN)]
        for lo in range(0, len(spans), ROWS):
            some = spans[lo : lo + ROWS]
            cut_out = [texts[k][max(0, i - CONTEXT) : i + SPAN + CONTEXT] for k, i in some]
            order = sorted(range(len(some)), key=lambda j: -len(cut_out[j]))
            size = np.array([len(cut_out[j]) for j in order])
            doc = np.array([some[j][0] for j in order])
            skip = np.array([min(some[j][1], CONTEXT) for j in order])  # positions before the span's own
            own = np.array([min(SPAN, len(texts[some[j][0]]) - some[j][1]) for j in order])
            steps = np.arange(size[0])[:, None]
            active = (steps < size).sum(1)
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            data = np.frombuffer(b"".join([cut_out[j] for j in order]), np.uint8)
            ahead = data[np.minimum(first + steps, len(data) - 1)]
            back = data[np.maximum(first + size - 1 - steps, 0)]
            start = np.concatenate([[0], np.cumsum(active)])  # of each step's outputs
            row = np.repeat(np.arange(len(size)), own)
            begin = np.concatenate([[0], np.cumsum(own)])[:-1]
            t = np.arange(len(row)) - begin[row] + skip[row]
            z = self._outputs("f", ahead.astype(np.intp), active)[start[t] + row]
            z += self._outputs("b", back.astype(np.intp), active)[start[size[row] - 1 - t] + row]
            z += self.p["bias"]
            np.add.at(total, doc, np.add.reduceat(_softmax(z), begin, 0, dtype=np.float64))
        return total

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        raw = [t.encode("utf-8") if has_letter(t) else b"" for t in texts]
        return [(self.languages[int(p.argmax())], min(1.0, round(float(p.max()) / len(r), 6))) if r else (UNKNOWN, 0.0) for p, r in zip(self.sums(raw), raw, strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(np.clip(z, -40, 40))
    return z / (z @ np.ones((z.shape[-1], 1), z.dtype))


def padded(raw: list) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and mask, [time, row]."""
    n = np.array([len(r) for r in raw])
    mask = np.arange(n.max()) < n[:, None]
    x = np.zeros(mask.shape, np.int64)
    x[mask] = _FOLD[np.concatenate([np.frombuffer(r, np.uint8) for r in raw])]
    return np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteGru | None:
    """The network, from the labelled documents outside the held-out fold; None if there are none."""
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("i"), "lang", "text")
    counts = cut(labelled.groupBy("lang").count())
    names = sorted(r["lang"] for r in counts.select("lang").collect())  # a row for each language
    if not names:
        return None
    space = 1 << 30
    order = F.xxhash64("i")
    chance = F.least(F.lit(float(space)), space * 1.5 * sample_docs / F.col("count") + 1)
    likely = labelled.join(F.broadcast(counts), "lang").where(F.pmod(order, F.lit(space)) < chance)
    some = likely.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "text"))).where(F.col("k") <= sample_docs)
    some = cut(some.select("lang", "text"))
    sizes = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row for each language

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, found = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                raw = text.encode("utf-8") if has_letter(text) else b""
                rng = np.random.default_rng(zlib.crc32(raw))
                n = int(len(raw) * WINDOWS / max(1, sizes[lang] or 1) + rng.random())
                for at in rng.integers(0, max(1, len(raw)), n).tolist():
                    lo = max(0, at - WINDOW // 2)
                    langs.append(lang)
                    found.append(raw[lo : lo + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    windows: dict[str, list[bytes]] = {k: [] for k in names}
    for r in some.mapInArrow(draw, "lang string, window binary").toLocalIterator():  # about WINDOWS for each language
        windows[r["lang"]].append(bytes(r["window"]))
    if not any(windows.values()):
        return None
    model = ByteGru(names).fit([sorted(w for w in windows[k] if len(w) > 1) for k in names])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            rows = [(lang, *model.familiarity((text.as_py() or "").encode("utf-8"), model.languages.index(lang))) for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            rows = [r for r in rows if r[3] >= LEAST_PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))], ["lang", "mean", "deviation"])

    seen: dict[str, list[tuple[float, float]]] = {k: [] for k in names}
    for r in some.mapInArrow(rate, "lang string, mean double, deviation double").toLocalIterator():  # two numbers a sample document
        seen[r["lang"]].append((r["mean"], r["deviation"]))
    return model.calibrate([seen[k] for k in names])


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language")
        model = sent.value
        for b in batches:
            for part in small(b, 1024):
                rows = model.read(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, model: ByteGru | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text is in a learned language: not ``und``, of at least this score, and familiar for its language. All
    columns stay. Without a model all rows stay."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language")
        model = sent.value
        for b in batches:
            for part in small(b, 1024):
                texts = part.column("text").to_pylist()
                keep = [x != UNKNOWN and s >= least and model.familiar(t, x) for t, (x, s) in zip(texts, model.read(texts), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
