"""Byte-level BPE encoding and decoding of whole texts.

A text is cut by the tokenizer's pattern; each match is merged separately. A merge keeps a segment tree over the
match's byte positions whose leaves hold the rank of the pair that starts there and whose root is the leftmost
minimum; a merge changes three leaves, each in logarithmic time, so a match of any length costs O(n log n). The trees
of all new short matches of a few hundred texts are kept side by side in numpy arrays and updated together
(``merge_all``); a long match has a tree of its own (``merge``).

Texts repeat their words, so results are kept per worker in caches of a fixed size. They change no result.

Nulls count as empty text; an empty text has no tokens and the digest of the empty string. Rows that repeat an id give
a row each. Columns other than the id and the text are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terradelta.llm.shared import tidy, worker_state

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries a worker's cache holds before its older half is dropped; workers keep it between tasks, about 300 bytes each.
CACHE_ENTRIES = 150_000
#: Pieces longer than this many characters are encoded but not kept in a cache.
CACHE_CHARS = 64

_DEAD = 1 << 62
#: Children of a node of the segment tree.
_WIDE = 16


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: the leftmost pair of lowest rank merges until no pair has a rank.

    Leaf i of the segment tree is rank * n + i of the pair that starts at byte i, so that of equal ranks the leftmost
    is the minimum. A node has up to 16 children, which keeps the tree of a common word one level deep.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    rank = ranks.get
    leaves = [_DEAD if (r := rank(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > _WIDE:
        low = levels[-1]
        levels.append([min(low[k : k + _WIDE]) for k in range(0, len(low), _WIDE)])
    top, deep = levels[-1], len(levels) > 1
    after = list(range(1, n + 2))  # where the part that starts here ends
    before = list(range(-1, n))
    while (best := min(top)) != _DEAD:
        i = best % n
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        if j < n - 1:
            leaves[j] = _DEAD
        if end < n and (r := rank(piece[i : after[end]])) is not None:
            leaves[i] = r * n + i
        else:
            leaves[i] = _DEAD
        p = before[i]
        if p >= 0:
            leaves[p] = _DEAD if (r := rank(piece[p:end])) is None else r * n + p
        if deep:  # the nodes above the three leaves
            changed = {i >> 4, j >> 4, p >> 4 if p >= 0 else i >> 4}
            for low, high in zip(levels, levels[1:], strict=False):
                for k in changed:
                    if k < len(high):
                        high[k] = min(low[k << 4 : (k << 4) + _WIDE])
                changed = {k >> 4 for k in changed}
    out, i = [], 0
    while i < n:
        end = after[i]
        out.append(ranks[piece[i:end]])
        i = end
    return out


class Tokenizer:
    """Encodes with the ranks of a tiktoken file and the pattern that goes with it."""

    def __init__(self, path: str | None = None, pattern: str | None = None, entries: int = CACHE_ENTRIES):
        import public_tokenizers
        import regex

        self.ranks: dict[bytes, int] = {}
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.names = {r: str(r) for r in self.tokens}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted(((self.ranks[t[:k]] << 32) | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.pairs = np.array([k for k, _ in pairs] + [_DEAD], np.int64)
        self.merged = np.array([r for _, r in pairs] + [-1], np.int64)
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self._most = entries
        self._young: dict[str, tuple[int, str, bytes]] = {}
        self._old: dict[str, tuple[int, str, bytes]] = {}

    def pair_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Leaves of the pairs of ids: rank * size + position, or dead where they have no rank."""
        key = (left << 32) | right
        k = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[k] == key, self.merged[k] * size + at, _DEAD)

    def merge_all(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces of 1 to ``size`` bytes, one after another, and how many each has. ``size``: a power of 2."""
        n = np.array([len(p) for p in pieces])
        w, width = len(pieces), size + 1
        inside = np.arange(width) < n[:, None]
        ids = np.zeros((w, width), np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        at = np.arange(size)
        levels = [np.where(inside[:, 1:], self.pair_keys(ids[:, :-1], ids[:, 1:], at, size), _DEAD)]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
        after = np.tile(np.arange(1, width + 1), (w, 1))
        before = np.tile(np.arange(-1, size), (w, 1))
        alive, root = inside, levels[-1][:, 0]
        rows = np.flatnonzero(root < _DEAD)
        while len(rows):
            best = root[rows]
            i, token = best & (size - 1), best // size
            j = after[rows, i]
            end = after[rows, j]
            after[rows, i] = end
            before[rows, end] = i
            ids[rows, i] = token
            alive[rows, j] = False
            p = before[rows, i]
            left = np.maximum(p, 0)
            here = np.where(end < n[rows], self.pair_keys(token, ids[rows, end], i, size), _DEAD)
            prior = np.where(p >= 0, self.pair_keys(ids[rows, left], token, left, size), here)
            levels[0][rows, np.minimum(j, size - 1)] = _DEAD
            levels[0][rows, i] = here
            levels[0][rows, np.where(p >= 0, p, i)] = prior
            for low, high in zip(levels, levels[1:], strict=False):  # the nodes above the three leaves
                i, j, left = i >> 1, np.minimum(j, low.shape[1] - 1) >> 1, left >> 1
                for k in (i, j, left):
                    high[rows, k] = np.minimum(low[rows, 2 * k], low[rows, 2 * k + 1])
            rows = rows[root[rows] < _DEAD]
        return ids[alive], alive.sum(1)

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes together what these cut texts hold and the cache lacks."""
        young, old = self._young, self._old
        new = {u for cut in texts for u in cut if u not in young and len(u) <= CACHE_CHARS}
        if len(young) + 2 * len(new) > self._most:
            self._old, self._young = old, young = young, {}
            new = {u for cut in texts for u in cut if len(u) <= CACHE_CHARS}
        for u in [u for u in new if u in old]:
            young[u] = old[u]
            new.discard(u)
        several, single = {}, set()
        for u in new:
            matches = self.find(u)
            if len(matches) == 1:
                single.add(u)
            else:
                several[u] = matches
                single.update([m for m in matches if m not in young])
        todo: dict[int, list[tuple[str, bytes]]] = {16: [], 64: []}
        ranks, names, tokens = self.ranks, self.names, self.tokens
        for m in single:
            piece = m.encode("utf-8")
            whole = ranks.get(piece)
            if whole is not None:
                young[m] = (1, names[whole], piece)
            elif len(piece) <= 64:
                todo[16 if len(piece) <= 16 else 64].append((m, piece))
            else:
                young[m] = self._made(merge(piece, ranks))
        for size, found in todo.items():
            if found:
                ids, counts = self.merge_all([p for _, p in found], size)
                ids, o = ids.tolist(), 0
                for (m, _), c in zip(found, counts.tolist(), strict=True):
                    own = ids[o : o + c]
                    o += c
                    young[m] = (c, ",".join([names[i] for i in own]), b"".join([tokens[i] for i in own]))
        for u, matches in several.items():
            counts, ids, raw = zip(*[young[m] for m in matches], strict=True)
            young[u] = (sum(counts), ",".join(ids), b"".join(raw))

    def _made(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join([self.names[i] for i in ids]), self.decode(ids)

    def match_ids(self, match: str) -> list[int]:
        """Ids of one match of the pattern."""
        return merge(match.encode("utf-8"), self.ranks)

    def encode(self, text: str) -> list[int]:
        return [int(i) for u in units(text) for i in self._unit(u)[1].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def _unit(self, unit: str) -> tuple[int, str, bytes]:
        """Of a text between two cuts: number of ids, the ids as text, and what they decode to."""
        found = self._young.get(unit)
        if found is not None:
            return found
        found = self._old.get(unit)
        if found is None:
            matches = self.find(unit)
            if len(matches) == 1:
                found = self._made(self.match_ids(unit))
            else:
                counts, ids, raw = zip(*map(self._unit, matches), strict=True)
                found = (sum(counts), ",".join(ids), b"".join(raw))
        if len(unit) <= CACHE_CHARS:
            if len(self._young) >= self._most:
                self._old, self._young = self._young, {}
            self._young[unit] = found
        return found

    @property
    def known(self) -> dict[str, tuple[int, str, bytes]]:
        """What ``learn`` has met of late."""
        return self._young

    def count(self, match: str) -> int:
        """Number of ids of one match of the pattern."""
        return self._unit(match)[0]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids and SHA-256 of what they decode to."""
        cuts, out = [units(x) for x in texts], []
        self.learn(cuts)
        sha = hashlib.sha256
        for cut in cuts:
            found = list(map(self._young.get, cut))
            if None in found:
                found = [self._unit(u) if f is None else f for u, f in zip(cut, found, strict=True)]
            counts, ids, raw = zip(*found, strict=True) if found else ((), (), ())
            out.append((sum(counts), sha(",".join(ids).encode()).hexdigest(), sha(b"".join(raw)).hexdigest()))
        return out


def units(text: str) -> list[str]:
    """Cuts a text before each space that a non-space follows. The pattern always starts a match there and never looks
    past such a cut, so the units' matches together are the text's matches."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts and not any(map(str.isspace, {p[0] for p in parts})):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out if out[0] else out[1:]




def tokenizer(path: str | None = None, pattern: str | None = None, entries: int = CACHE_ENTRIES) -> Tokenizer:
    """This worker's tokenizer for a rank file, with a cache of that size."""
    made = worker_state("tokens")
    if (path, pattern, entries) not in made:
        made[path, pattern, entries] = Tokenizer(path, pattern, entries)
    return made[path, pattern, entries]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each text: id, ``ids`` array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for part in small(b):
                ids = [t.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that each row's ids stand for: id, ``decoded`` binary. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            raw = [t.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that only a few texts are Python objects at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", step: int = 512, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Encodes each text, decodes its ids again, and gives n_tokens, ids_sha256 and decoded_sha256 per row.

    step: texts that are cut and merged together; entries: of the cache. Both set a worker's memory and change no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, entries=entries)
        for b in batches:
            for part in small(b, step):
                rows = t.digests([x or "" for x in part.column(1).to_pylist()])
                n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
