"""Spelling variants: words one edit apart, by an index of grams of variable length.

The gram dictionary is pruned by frequency: a gram of two letters or more is extended by the letter that follows it only
while more than one in ``SHARES`` of all grams of its length in the vocabulary are equal to it, and not beyond ``LONGEST``.
So frequent beginnings grow into longer, rarer grams. At most ``SHARES`` grams of each length are that frequent, so the
dictionary of frequent grams has a size that does not depend on the vocabulary, and only it is sent to tasks.

A word is decomposed into the gram that begins at each of its letters. An edit affects just the grams that cover its
place. A word's index entries are its rarest grams, in one order for all words, up to the first at which no single edit
affects all of them (with all further places of that last gram): if two words are one edit apart, their entries share a
gram that the edit leaves alone, since of the two words, the one whose last entry comes first loses not all its entries,
and the other one, whose entries reach further in the order, has what is left. Words of length L meet those of L and
L + 1, with grams of half of L at most, so that the first and the last gram never overlap and entries always suffice.

As the edit lies on one side of a gram that it leaves alone, the other side is equal in both words: a gram's inverted
list is cut by what stands before it, and again by what stands behind it. Lists are merged in tasks, where pairs are
verified by letters; lists of more than ``BLOCK`` words are dealt to blocks, each pair of blocks in one task. Found pairs
are made distinct before they are counted, and no word has more than about 180 times its length of them.

Words are counted per task before the shuffle. A null text has no words; a null doc_id is written as nothing in the hash.
Rows that repeat a doc_id count each. Words as long as a text are indexed like others. An empty table gives no rows. Of
near words that occur equally often the first in code-point order is the form. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.llm.shared import cut, salted_join

RUN = "[A-Za-zÀ-ÿ]+"
#: Of so many hashes of document and word, one spoils the word (a fixed value of the contract).
SPOILS = 199
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often.
RATIO = 5
SHORTEST, LONGEST = 2, 8
#: A gram is frequent if it has more than one in so many of its length's places in the vocabulary.
SHARES = 20_000
#: Words of a list are compared in blocks of about so many.
BLOCK = 256
#: Words or grams that a task counts before it passes them on.
HELD = 400_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of words of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences, after spoiling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        counts: Counter = Counter()
        for b in batches:
            for doc, text in zip(*(b.column(i) for i in range(2)), strict=True):
                key = f"{'' if doc.as_py() is None else doc.as_py()}:".encode()
                begun = zlib.crc32(key)
                for word, n in Counter(find((text.as_py() or "").translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % SPOILS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) > HELD:
                    yield _counted(counts, "word")
                    counts.clear()
        yield _counted(counts, "word")

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counted(counts: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], [name, "n"])


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The grams that are extended, with how often they occur: at most ``SHARES`` of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for word in b.column(0).to_pylist():
                for size in range(SHORTEST, LONGEST):
                    counts.update(word[k : k + size] for k in range(len(word) - size + 1))
                if len(counts) > HELD:
                    yield _counted(counts, "gram")
                    counts.clear()
        yield _counted(counts, "gram")

    grams = cut(words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    places = grams.groupBy(F.length("gram").alias("size")).agg((F.sum("n") / SHARES).alias("least"))
    found = grams.join(F.broadcast(places), F.length("gram") == F.col("size")).where(F.col("n") > F.greatest("least", F.lit(1.0)))
    return {r["gram"]: r["n"] for r in found.select("gram", "n").collect()}  # SHARES a length at most


def decompose(word: str, cap: int, frequent: dict[str, int]) -> list[str]:
    """The gram at each place of a word: the shortest that is not frequent, or that has ``cap`` letters or ends the word."""
    out = []
    for k in range(len(word) - SHORTEST + 1):
        end = k + SHORTEST
        while end - k < cap and end < len(word) and word[k:end] in frequent:
            end += 1
        out.append(word[k:end])
    return out


def entries(word: str, cap: int, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram) of the word's rarest grams, up to where no single edit affects all of them.

    A gram that ended only because the word did is also affected by an edit behind the last letter.
    """
    grams = decompose(word, cap, frequent)
    ranked = sorted(range(len(grams)), key=lambda k: (frequent.get(grams[k], 0), -len(grams[k]), grams[k], k))
    low, high = 0, len(word)  # the places that affect all entries so far
    for n, k in enumerate(ranked):
        g = grams[k]
        open_end = k + len(g) == len(word) and len(g) < cap and g in frequent
        low, high = max(low, k), min(high, k + len(g) - 1 + open_end)
        if low > high and (n + 1 == len(ranked) or grams[ranked[n + 1]] != g):
            return [(p, grams[p]) for p in ranked[: n + 1]]
    return [(p, grams[p]) for p in ranked]


def inverted_lists(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """(key, id, word): a word's entries; key stands for the shorter length of the pairs sought, the gram and what is on one side of it."""
    sent = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                keys, row = [], []
                for i, word in enumerate(b.column(1).to_pylist()):
                    own_keys = set()
                    for short in range(max(LEAST_LETTERS, len(word) - 1), len(word) + 1):
                        for k, g in entries(word, min(LONGEST, short // 2), known):
                            own_keys.update((f"{short}<{word[: k + len(g)]}", f"{short}>{word[k:]}"))
                    keys += own_keys
                    row += [i] * len(own_keys)
                own = b.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), own.column(0), own.column(1)], ["key", "id", "word"])

    listed = words.select("id", "word").mapInArrow(run, "key string, id long, word string")
    return listed.select(F.xxhash64("key").alias("key"), "id", "word")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _near(ids: list[int], words: list[str], side: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs of ids one edit apart; sides 0 and 1 meet each other, side 2 its own."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(words[j]) > len(words[i]) + 1:
                break
            if (side[i] == 2 or side[i] != side[j]) and one_edit(words[i], words[j]):
                yield min(ids[i], ids[j]), max(ids[i], ids[j])


def near_pairs(lists: DataFrame) -> DataFrame:
    """(a, b), a below b: the ids of all pairs of words one edit apart that share an entry."""
    sizes = cut(lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    together = salted_join(lists, sizes, "key", "id", sizes.select("key", F.col("members").alias("n")))
    blocks = F.ceil(F.col("members") / BLOCK)
    mine = F.pmod(F.xxhash64("id"), blocks)
    cell = lambda j: F.struct(F.least("mine", j).alias("x"), F.greatest("mine", j).alias("y"), F.when(F.col("mine") == j, 2).when(F.col("mine") < j, 0).otherwise(1).alias("side"))
    placed = together.withColumn("mine", mine).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), cell)))
    dealt = placed.select(F.xxhash64("key", "cell.x", "cell.y").alias("cell"), "cell.side", "id", "word").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])
        for batch in batches:
            cells, side, ids, words = (batch.column(k).to_pylist() for k in range(4))
            found: set[tuple[int, int]] = set()
            edge = (np.flatnonzero(np.diff(np.array(cells, np.int64))) + 1).tolist() if cells else []
            for lo, hi in zip([0, *edge], [*edge, len(cells)], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != key:
                    found.update(_near(*held))
                    key, held = cells[lo], ([], [], [])
                for have, more in zip(held, (ids, words, side), strict=True):
                    have += more[lo:hi]
            yield pairs(found)
        yield pairs(set(_near(*held)))

    def pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms. A form occurs ``RATIO`` times as often as its word, so chains
    are short; each round doubles how far a word sees."""
    reach = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        grown = cut(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if grown.where("moved").isEmpty():
            return grown.select("word", "root")
        reach = grown.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = cut(word_counts(docs).withColumn("id", F.monotonically_increasing_id()))
    pairs = cut(near_pairs(inverted_lists(counted, frequent_grams(counted))))
    both = pairs.union(pairs.select("b", "a"))
    own, other = (counted.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(n)) for i, w, n in (("a", "word", "n"), ("b", "near", "near_n")))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word")))
    near = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    named = cut(own.join(near, "a", "left").withColumn("form_n", F.when(-F.col("best.order") >= RATIO * F.col("n"), -F.col("best.order"))))
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("best.word")).alias("form"))
    roots = _followed(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
