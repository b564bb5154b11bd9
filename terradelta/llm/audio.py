"""Audio features of 8-bit sounds: polyphase resampling, log-mel filterbanks and energy segments.

A sound is a RIFF/WAVE file of unsigned 8-bit mono samples at ``RATE``. It is resampled by ``UP / DOWN`` with a windowed
sinc whose taps are dealt to phases, so that no inserted zero is ever multiplied. Overlapping windowed frames give power
spectra, triangular mel filters and logarithms. Segments come from the frames' energy by hysteresis: one opens when the
energy rises above the high mark and closes when it falls below the low mark, both set relative to the sound's mean.

The mel frames of a whole sound are pooled over time into ``SLOTS`` equal spans, which gives a tensor of a fixed shape,
[SLOTS, MELS], whatever the length; ``tensor_table`` writes tensors with their time spans under Arrow's fixed-shape
tensor type. Samples are resampled and framed in blocks of ``BLOCK_FRAMES`` frames; of a sound's frames only their
energies are kept, 8 bytes each, so a long sound takes little more memory than its own bytes. Each sound is computed by
itself in a fixed order, so equal sounds have equal features.

In ``text_media``, a payload is the text's UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576; null is
empty text. The sounds are written to a table in the shared folder; their features are computed from what is read back and
written as Arrow streams of fixed-shape tensors with time spans, which are read in turn. Rows that repeat an id give a row each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm.bpe import small
from terradelta.llm.shared import shared_folder

RATE, UP, DOWN = 16_000, 3, 8
FRAME, HOP, MELS, SLOTS = 256, 128, 16, 8
TAPS = 8
BLOCK_FRAMES = 2048
HIGH, LOW = 0.5, -0.5
PAD, PAD_BYTE = 576, 255


def padded(raw: bytes) -> bytes:
    """Filled up to a positive multiple of 576 bytes."""
    size = max(1, -(-len(raw) // PAD)) * PAD
    return raw + bytes([PAD_BYTE]) * (size - len(raw))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples."""
    fill = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(fill), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + fill


def wav_samples(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a WAVE file of unsigned 8-bit mono samples; raises ValueError for another format."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("a WAVE file is cut short")
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file has no data")


@cache
def _phases(up: int, down: int) -> np.ndarray:
    """Filter taps, [phase, tap]: phase p makes the outputs at input position k + p / up."""
    n = 2 * TAPS * max(up, down) // up
    at = (np.arange(n) - n // 2)[None, :] - np.arange(up)[:, None] / up
    cutoff = min(1.0, up / down)
    taps = cutoff * np.sinc(cutoff * at) * np.cos(np.pi * np.clip(at / (n + 2), -0.5, 0.5)) ** 2
    return taps / taps.sum(1, keepdims=True)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, count: int | None = None, silence: float = 0.0) -> np.ndarray:
    """``count`` samples from ``first`` on of x resampled by up / down; outside x there is silence. x may be of any number
    type. Outputs of one phase are ``up`` apart and their inputs ``down`` apart, so each phase is one product of strided
    windows with its taps."""
    taps = _phases(up, down)
    n = taps.shape[1]
    whole = -(-len(x) * up // down)
    count = whole - first if count is None else count
    lo = first * down // up - n // 2
    hi = (first + count - 1) * down // up + n - n // 2
    room = np.full(max(0, hi - lo), silence)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        room[a - lo : b - lo] = x[a:b]
    room -= silence
    out = np.empty(count)
    for k in range(min(up, count)):
        at = (first + k) * down
        windows = np.lib.stride_tricks.sliding_window_view(room[at // up - n // 2 - lo :], n)[::down]
        mine = out[k::up]
        mine[:] = windows[: len(mine)] @ taps[at % up]
    return out


@cache
def _filters(rate: float) -> np.ndarray:
    """Triangular mel filters, [bin, mel]."""
    mel = lambda f: 1127 * np.log1p(f / 700)
    edges = 700 * np.expm1(np.linspace(mel(0.0), mel(rate / 2), MELS + 2) / 1127)
    f = np.arange(FRAME // 2 + 1)[:, None] * rate / FRAME
    up = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


@cache
def _window() -> np.ndarray:
    return np.hanning(FRAME)


def log_mel(samples: np.ndarray, up: int = UP, down: int = DOWN, rate: float = RATE, silence: float = 0.0, scale: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of log-mel frames and of their log energies, of samples that are resampled block by block; the last frame is
    filled with silence."""
    length = -(-len(samples) * up // down)
    frames = frame_count(length)
    filters = _filters(rate * up / down)
    for at in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - at)
        first = at * HOP
        x = resample(samples, up, down, first, (n - 1) * HOP + FRAME, silence) * scale
        x[max(0, length - first) :] = 0
        power = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _window())
        power = power.real**2 + power.imag**2
        yield np.log(power @ filters + 1e-6), np.log(power.mean(1) + 1e-6)


def frame_count(length: int) -> int:
    return max(1, -(-(length - FRAME) // HOP) + 1)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """[first, end) frames of segments by hysteresis around the mean energy."""
    level = energy - energy.mean()
    state = np.where(level > high, 1, np.where(level < low, -1, 0))
    known = np.flatnonzero(state)
    if not len(known):
        return []
    at = np.searchsorted(known, np.arange(len(state)), "right") - 1
    on = np.where(at >= 0, state[known[np.maximum(at, 0)]] > 0, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(media: bytes) -> dict:
    """tensor [SLOTS, MELS] float32, spans of its slots and segments, all times in seconds."""
    rate, raw = wav_samples(media)
    samples = np.frombuffer(raw, np.uint8)
    frames = frame_count(-(-len(samples) * UP // DOWN))
    edge = np.arange(SLOTS + 1) * frames // SLOTS
    first = np.minimum(edge[:-1], frames - 1)
    last = np.maximum(edge[1:], first + 1)
    total, energy, at = np.zeros((SLOTS, MELS)), np.empty(frames), 0
    for mel, e in log_mel(samples, rate=rate, silence=128.0, scale=1 / 128):
        energy[at : at + len(e)] = e
        for k in np.flatnonzero((first < at + len(e)) & (last > at)):
            total[k] += mel[max(0, first[k] - at) : last[k] - at].sum(0)
        at += len(e)
    tensor = np.round(total / (last - first)[:, None], 2).astype(np.float32)  # the same whatever order a library adds in
    second = HOP / (rate * UP / DOWN)
    return {
        "tensor": tensor,
        "slots": [(float(a * second), float(b * second)) for a, b in zip(first.tolist(), last.tolist(), strict=True)],
        "segments": [(a * second, b * second) for a, b in segments(energy)],
        "frames": frames,
    }


def feature_text(f: dict) -> str:
    """Frames, segments, their share, and a digest of the tensor rounded to hundredths."""
    held = sum(b - a for a, b in f["segments"])
    digest = hashlib.sha256(np.round(f["tensor"] * 100).astype("<i4").tobytes()).hexdigest()[:16]
    return f"frames={f['frames']};segments={len(f['segments'])};active={held:.3f};logmel={digest}"


def media_of(payloads: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """(id, media): binary payloads, as 8-bit samples, in WAVE files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([wav(x or b"") for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return payloads.select(F.col(id_col).cast("long"), payload_col).mapInArrow(run, "doc_id long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """(doc_id, tensor, slots, segments): the features of a column of WAVE files. A null file has null features."""
    span = "array<struct<start:double,end:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        for b in batches:
            for part in small(b):
                found = [None if x is None else features(x) for x in part.column(1).to_pylist()]
                cells = [[None if f is None else [{"start": s, "end": e} for s, e in f[k]] for f in found] for k in ("slots", "segments")]
                tensors = [None if f is None else f["tensor"].ravel() for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tensors, pa.list_(pa.float32())), *(pa.array(c, times) for c in cells)], ["doc_id", "tensor", "slots", "segments"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, f"doc_id long, tensor array<float>, slots {span}, segments {span}")


def tensor_table(rows: list[dict]) -> pa.Table:
    """A few rows of ``audio_features`` as an Arrow table whose tensor column has the fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), [SLOTS, MELS])
    flat = pa.array([x for r in rows for x in r["tensor"]], pa.float32())
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, SLOTS * MELS))
    spans = pa.array([[{"start": s["start"], "end": s["end"]} for s in r["slots"]] for r in rows], pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])))
    return pa.table({"doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()), "tensor": tensors, "slots": spans})


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def tensors_ipc(found: DataFrame) -> DataFrame:
    """(content): the features as Arrow IPC streams whose tensor column has the fixed-shape tensor type, one per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b, 4096):
                table = tensor_table([r for r in part.to_pylist() if r["tensor"] is not None])
                yield pa.RecordBatch.from_arrays([pa.array([_stream(table)], pa.binary())], ["content"])

    return found.select("doc_id", "tensor", "slots").mapInArrow(run, "content binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor array<float>, slots array<struct<start:double,end:double>>, segments array<struct<start:double,end:double>>"
_DIGESTS = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def write_media(docs: DataFrame, folder: str) -> DataFrame:
    """Writes every text as a sound, (doc_id, n_bytes, media), and gives the table that was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b):
                raw = [(x or "").encode("utf-8") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def write_tensors(media: DataFrame, folder: str) -> DataFrame:
    """Writes, for the table of ``write_media``, Arrow streams of tensors, slots, segments and digests; gives the table (content) that was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b):
                rows, digests = [], []
                for doc_id, n_bytes, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    _, back = wav_samples(x)
                    f = features(x)
                    spans = {k: [{"start": s, "end": e} for s, e in f[k]] for k in ("slots", "segments")}
                    rows.append({"doc_id": doc_id, "tensor": f["tensor"].ravel(), **spans})
                    digests.append((n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(x), hashlib.sha256(x).hexdigest(), feature_text(f)))
                table = tensor_table(rows)
                table = table.append_column("segments", pa.array([r["segments"] for r in rows], table.schema.field("slots").type))
                for field, column in zip(_DIGESTS, zip(*digests, strict=True), strict=True):
                    table = table.append_column(field, pa.array(column, field.type))
                yield pa.RecordBatch.from_arrays([pa.array([_stream(table)], pa.binary())], ["content"])

    media.select("doc_id", "n_bytes", "media").mapInArrow(run, "content binary").write.option("compression", "zstd").parquet(folder)
    return media.sparkSession.read.parquet(folder)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a sound, read back, and its features, stored as tensors and read back; one row per row of the input."""
    folder = f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                for part in pa.ipc.open_stream(x.as_buffer()):
                    flat = part.column("tensor").storage.flatten()
                    size = SLOTS * MELS
                    tensors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * size, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(k) for k in _DIGESTS.names), tensors, part.column("slots"), part.column("segments")], ["doc_id", *_DIGESTS.names, "tensor", "slots", "segments"])

    return write_tensors(write_media(docs, f"{folder}/sounds"), f"{folder}/tensors").mapInArrow(run, _DIGEST)
