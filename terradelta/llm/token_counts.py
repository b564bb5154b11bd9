"""Token counts that follow edits.

A document's pre-tokens (the pattern's matches) are the leaves of a segment tree, in blocks of up to ``BLOCK``; each node
sums characters and tokens. An edit replaces a range of characters. Only pre-tokens that the edit touches are split and
encoded again, with the boundary context that the pattern can look at: a match depends on at most two characters past
its end, so splitting starts at the first pre-token that ends less than two characters before the edit, and stops at the
first boundary past the edit that was a boundary before, as from there on the pattern sees the same text. Then the sums
above the changed blocks are renewed; all other blocks stay as they are.

Edits of a row apply in their order, each to the text as it then is; positions count code points and are held to the
text's range, and a null text in an edit deletes. Null texts are empty; null edits are none. Rows that repeat a doc_id
give a row each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.bpe import Tokenizer, small, tokenizer

BLOCK, FULL = 64, 512
#: Characters past a match that its end may depend on.
CONTEXT = 2


class TokenTree:
    """The pre-tokens of one text, each with its number of tokens, and sums of characters and tokens over them."""

    def __init__(self, tok: Tokenizer, pretokens: list[str]):
        self.tok = tok
        self._build(pretokens)

    def _counts(self, pretokens: list[str]) -> list[int]:
        known, unit = self.tok.known, self.tok.count
        return [f[0] if (f := known.get(m)) else unit(m) for m in pretokens]

    def _build(self, pretokens: list[str], counts: list[int] | None = None) -> None:
        counts = self._counts(pretokens) if counts is None else counts
        self.blocks = [pretokens[i : i + BLOCK] for i in range(0, len(pretokens), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        pad = [0] * (self.size - len(self.blocks))
        self.chars = [0] * self.size + [sum(map(len, b)) for b in self.blocks] + pad
        self.tokens = [0] * self.size + [sum(b) for b in self.counts] + pad
        for v in range(self.size - 1, 0, -1):
            self._add_up(v)

    def _add_up(self, v: int) -> None:
        self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
        self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    def _renew(self, block: int) -> None:
        v = self.size + block
        self.chars[v] = sum(map(len, self.blocks[block]))
        self.tokens[v] = sum(self.counts[block])
        v >>= 1
        while v:
            self._add_up(v)
            v >>= 1

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds a character position, and the position of its first character."""
        v, start = 1, 0
        while v < self.size:
            v *= 2
            if at >= start + self.chars[v]:
                start += self.chars[v]
                v += 1
        block = v - self.size
        if block >= len(self.blocks):  # past the end
            block = len(self.blocks) - 1
            start = self.chars[1] - self.chars[self.size + block]
        return block, start

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join([m for b in self.blocks for m in b])

    def edit(self, start: int, end: int, new: str | None) -> int:
        """Replaces characters [start, end) and gives the number of pre-tokens that were split again."""
        new, n = new or "", self.chars[1]
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        first, at = self._find(max(0, start - CONTEXT - 1))
        k = 0
        while k < len(self.blocks[first]) and at + len(self.blocks[first][k]) + CONTEXT <= start:
            at += len(self.blocks[first][k])
            k += 1
        if k == len(self.blocks[first]) and first + 1 < len(self.blocks):
            first, k = first + 1, 0
        before, before_n = self.blocks[first][:k], self.counts[first][:k]
        last, old, old_n, ends, stop = first, self.blocks[first][k:], self.counts[first][k:], [], at
        for m in old:
            stop += len(m)
            ends.append(stop)
        while True:
            while last + 1 < len(self.blocks) and stop < end + CONTEXT + 1:
                last += 1
                old_n += self.counts[last]
                for m in self.blocks[last]:
                    stop += len(m)
                    old.append(m)
                    ends.append(stop)
            whole = "".join(old)
            found = self.tok.find(whole[: start - at] + new + whole[end - at :])
            boundaries, shift, q, synced = set(ends), (end - start) - len(new), at, None
            final = last + 1 == len(self.blocks)
            for i, m in enumerate(found):
                q += len(m)
                if q + shift >= end and q >= start + len(new) and q + shift in boundaries and (final or q + shift + CONTEXT <= stop):
                    synced = (i + 1, q + shift)
                    break
            if synced or final:
                break
            last += 1
            old_n += self.counts[last]
            for m in self.blocks[last]:
                stop += len(m)
                old.append(m)
                ends.append(stop)
        done, same = synced or (len(found), stop)
        kept = ends.index(same) + 1 if same in boundaries else len(old)
        merged = before + found[:done] + old[kept:]
        merged_n = before_n + self._counts(found[:done]) + old_n[kept:]  # nothing else is encoded again
        if len(merged) > FULL:
            flat = lambda parts: [m for b in parts for m in b]
            self._build(flat(self.blocks[:first]) + merged + flat(self.blocks[last + 1 :]), flat(self.counts[:first]) + merged_n + flat(self.counts[last + 1 :]))
        else:
            self.blocks[first], self.counts[first] = merged, merged_n
            for b in range(first + 1, last + 1):
                self.blocks[b], self.counts[b] = [], []
            for b in range(first, last + 1):
                self._renew(b)
        return done


def sample_edits(text: Column, source: Column) -> Column:
    """Two edits for each text: 20 characters deleted after a third, and a note inserted after two thirds."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    third = F.floor(n / 3)
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), new.alias("text"))
    return F.array(edit(third, third + 20, F.lit("")), edit(third * 2, third * 2, F.concat(F.lit(" [from "), F.coalesce(source, F.lit("?")), F.lit("] "))))


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """From doc_id, text, edits: n_pretokens, n_tokens, and after the edits n_tokens_edited, with the n_reencoded pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        names = ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded"]
        for b in batches:
            for part in small(b):
                split = [tok.find(x or "") for x in part.column(1).to_pylist()]
                tok.learn(split)
                rows = []
                for pre, edits in zip(split, part.column(2).to_pylist(), strict=True):
                    tree = TokenTree(tok, pre)
                    n = tree.n_tokens
                    again = sum(tree.edit(e["start"], e["end"], e["text"]) for e in edits or ())
                    rows.append((len(pre), n, tree.n_tokens, again))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    return docs.select(F.col("doc_id").cast("long"), "text", "edits").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long")
