"""Reversible line dedup: exact reference counts of lines, behind sharded cuckoo filters.

A line's key is the line stripped of space and TAB to CR at both ends, with A-Z in lower case; lines whose key has fewer
than ``min_chars`` code points are left alone. *Postings* (key, doc_id) say which documents hold a key; *references*
(key, n_docs, keeper) count them and name the largest doc_id. A key held by ``min_docs`` documents or more loses its
lines everywhere but in its keeper.

A ``LineStore`` keeps both as tables to which every change appends rows with its version, and one cuckoo filter for each
shard of the key space. When documents come, the new keys are counted and dealt to their shards, where a task asks its
shard's filter which of them may be known: only those are looked up in the references; all others are new for sure,
are appended without a look-up, and enter the filter. When documents go, the counts of their keys are renewed, and keys
that no document holds any more leave their filter, as cuckoo filters, unlike Bloom filters, can forget. The references
are the truth: a filter errs only towards "perhaps". A shard is planned for ``capacity`` keys; when the store outgrows
its shards, their number is doubled and the filters are built anew from the references. No filter leaves its shard's task.

A key is kept as 16 bytes of BLAKE2b. No step gathers the holders of a key: counts and maxima are combined before the
shuffle, shards hold distinct keys only, and joins of postings with keys salt the hot ones. To drop lines, the keys held
by enough documents are sent to the tasks while they are no more than ``SENT_KEYS`` (counted), so that no text is
shuffled; beyond, each document's lost keys are joined to its text. Both give the same rows.

Null or empty text is one empty line and loses nothing. Rows with a null doc_id neither count nor lose lines. Rows that
repeat a doc_id are one document: a key counts once for it, and every such row loses the same keys. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.bpe import small
from terradelta.llm.shared import SENT_IDS, by_ids, cut, remove, salted_join, shared_folder, tidy, worker_state

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys a shard's filter is planned for (about 400 KB).
KEYS_PER_SHARD = 1 << 16
#: Shards that a store begins with, so that small stores are spread too.
FIRST_SHARDS = 64
#: Up to so many keys with their keepers (24 bytes each) are sent to tasks.
SENT_KEYS = 1_000_000
#: Batches that ``dedup_lines`` adds a table in.
BATCHES = 2
#: Versions of a table that are read together before they are merged.
MOST_VERSIONS = 16

_BLANK = " \t\n\v\f\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_SLOTS = 4


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    key = line.strip(_BLANK)
    if len(key) < min_chars:
        return None
    key = key.lower() if key.isascii() else key.translate(_LOWER)
    return hashlib.blake2b(key.encode("utf-8"), digest_size=16).digest()


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id) for each key of each row, once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("lines")
        for b in batches:
            for part in small(b, 1024):
                keys, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}
                    keys += own
                    rows += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0).take(pa.array(rows, pa.int32()))], ["key", "doc_id"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "key binary, doc_id long")


def references(posted: DataFrame) -> DataFrame:
    """(key, n_docs, keeper) of postings without repeats."""
    return posted.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _words(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class CuckooFilter:
    """A set of 16-byte keys, by fingerprints of 32 bits in one of two buckets of four slots.

    Keys that find no slot go to a stash of whole keys, so no key is ever lost. ``remove`` must only be asked for keys
    that are in the set, which the reference counts know.
    """

    def __init__(self, capacity: int, slots: np.ndarray | None = None, stash: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / _SLOTS / 0.8))))
        self.slots = np.zeros((buckets, _SLOTS), np.uint32) if slots is None else slots
        self.stash = np.zeros(0, np.uint64) if stash is None else stash

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = (words[:, 0] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        prints = np.maximum((words[:, 0] >> np.uint64(32)).astype(np.uint32), 1)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1))

    def add(self, keys: list[bytes], rounds: int = 200) -> None:
        prints, bucket, _ = self._places(_words(keys))
        random = np.random.default_rng(len(self.slots))
        for turn in range(rounds):
            for _ in range(2):  # a free slot in either bucket
                for s in range(_SLOTS):
                    if len(prints):
                        free = np.flatnonzero(self.slots[bucket, s] == 0)
                        free = free[np.unique(bucket[free], return_index=True)[1]]
                        self.slots[bucket[free], s] = prints[free]
                        left = np.ones(len(prints), bool)
                        left[free] = False
                        prints, bucket = prints[left], bucket[left]
                bucket = self._other(bucket, prints)
            if not len(prints) or turn == rounds - 1:
                break
            push = np.unique(bucket, return_index=True)[1]  # else one per bucket takes a slot, whose print moves on
            s = random.integers(0, _SLOTS, len(push))
            moved = self.slots[bucket[push], s]
            self.slots[bucket[push], s] = prints[push]
            prints[push] = moved
            bucket[push] = self._other(bucket[push], moved)
        if len(prints):  # by bucket and fingerprint, as pushed-out prints have no key any more
            self.stash = np.concatenate([self.stash, self._stashed(prints, np.minimum(bucket, self._other(bucket, prints)))])

    def _stashed(self, prints: np.ndarray, low: np.ndarray) -> np.ndarray:
        return (low.astype(np.uint64) << np.uint64(32)) | prints.astype(np.uint64)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        prints, a, b = self._places(_words(keys))
        found = (self.slots[a] == prints[:, None]).any(1) | (self.slots[b] == prints[:, None]).any(1)
        return found | np.isin(self._stashed(prints, np.minimum(a, b)), self.stash) if len(self.stash) else found

    def remove(self, keys: list[bytes]) -> None:
        for p, a, b in zip(*self._places(_words(keys)), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.slots[bucket] == p)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break
            else:
                at = np.flatnonzero(self.stash == self._stashed(np.array([p]), np.array([min(a, b)]))[0])
                self.stash = np.delete(self.stash, at[:1])

    def size(self) -> int:
        return int(np.count_nonzero(self.slots)) + len(self.stash)

    def dump(self) -> bytes:
        np.savez(out := io.BytesIO(), slots=self.slots, stash=self.stash)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        got = np.load(io.BytesIO(raw))
        return cls(0, got["slots"], got["stash"])


def _by_shard(keys: DataFrame, filters: DataFrame, shards: int, step, out: str) -> DataFrame:
    """``step(shard, filter or None, keys)`` for each shard, in a task of its own. keys: (key, ...), each key once."""

    def run(key: tuple, own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        return step(key[0], CuckooFilter.load(stored["filter"].iloc[0]) if len(stored) else None, own)

    dealt = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, out)


_FILTER = "shard int, filter binary, n_keys long"


def _changed(keys: DataFrame, filters: DataFrame, shards: int, capacity: int, add: bool) -> DataFrame:
    """The filters with these keys added, or removed. filters: (shard, filter, n_keys)."""

    def step(shard: int, f: CuckooFilter | None, own: pd.DataFrame) -> pd.DataFrame:
        f = f or CuckooFilter(capacity)
        if len(own):
            (f.add if add else f.remove)(list(own["key"]))
        return pd.DataFrame({"shard": [shard], "filter": [f.dump()], "n_keys": [f.size()]})

    return _by_shard(keys.select("key"), filters, shards, step, _FILTER)


def _probed(counted: DataFrame, filters: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Of each shard: its keys, with ``perhaps`` where its filter may hold them, and a row with the filter after those that
    it surely did not hold were added."""

    def step(shard: int, f: CuckooFilter | None, own: pd.DataFrame) -> pd.DataFrame:
        f = f or CuckooFilter(capacity)
        keys = list(own["key"])
        perhaps = f.contains(keys) if keys else np.zeros(0, bool)
        if not perhaps.all():
            f.add([k for k, p in zip(keys, perhaps, strict=True) if not p])
        after = pd.DataFrame({"shard": [shard], "filter": [f.dump()], "n_keys": [f.size()]})
        return pd.concat([own[["key", "n_docs", "keeper"]].assign(shard=shard, perhaps=perhaps), after])[["key", "n_docs", "keeper", "perhaps", *after.columns]].astype({"n_docs": "Int64", "keeper": "Int64", "perhaps": "boolean", "n_keys": "Int64"})

    return _by_shard(counted, filters, shards, step, f"key binary, n_docs long, keeper long, perhaps boolean, {_FILTER}")


def _of_keys(posted: DataFrame, keys: DataFrame) -> DataFrame:
    """The postings of these distinct keys."""
    keys = cut(keys.select("key"))
    return posted.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= SENT_IDS else salted_join(posted, keys, "key", "doc_id")


_DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _drop(docs: DataFrame, stays, with_text: bool, gone: str | None = None) -> DataFrame:
    """Each row without the lines that ``stays`` (doc_ids, keys, each line's row, the batch) says go: doc_id, n_lines,
    n_dropped, kept_sha256, or with text the row's own columns with its new text. The column named ``gone`` is for ``stays`` and does not stay."""

    def lines_of(part: pa.RecordBatch, min_chars: int = MIN_CHARS) -> Iterator[tuple[list[str], np.ndarray]]:
        texts = [(t or "").split("\n") for t in part.column("text").to_pylist()]
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        keys = [line_key(x, min_chars) for own in texts for x in own]
        keep = stays(part, keys, rows)
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        for own, lo in zip(texts, at.tolist(), strict=False):
            yield own, keep[lo : lo + len(own)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b):
                n, dropped, sha = [], [], []
                for own, keep in lines_of(part):
                    left = own if keep.all() else [x for x, k in zip(own, keep, strict=True) if k]
                    n.append(len(own))
                    dropped.append(len(own) - len(left))
                    sha.append(hashlib.sha256("\n".join(left).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b):
                texts = part.column("text").to_pylist()
                for i, (own, keep) in enumerate(lines_of(part)):
                    if not keep.all():
                        texts[i] = "\n".join([x for x, k in zip(own, keep, strict=True) if k])
                names = [n for n in part.schema.names if n != gone]
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(n).type) if n == "text" else part.column(n) for n in names], names)

    if with_text:
        return docs.mapInArrow(tidy(rewrite), docs.drop(gone).schema if gone else docs.schema)
    return docs.select(F.col("doc_id").cast("long"), "text", *[c for c in (gone,) if c]).mapInArrow(tidy(digest), _DIGEST)


def _drop_sent(docs: DataFrame, busy: DataFrame, with_text: bool) -> DataFrame:
    """busy: (key, keeper), at most ``SENT_KEYS`` rows."""
    rows = sorted((bytes(r["key"]), r["keeper"]) for r in busy.toLocalIterator())
    sent = docs.sparkSession.sparkContext.broadcast((np.array([k for k, _ in rows], "S16"), np.array([x for _, x in rows], np.int64)))

    def stays(part: pa.RecordBatch, keys: list[bytes | None], rows: np.ndarray) -> np.ndarray:
        known, keeper = sent.value
        keep = np.ones(len(keys), bool)
        has = np.flatnonzero([k is not None for k in keys])
        if len(has) and len(known):
            mine = np.array([keys[i] for i in has], "S16")
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            ids = part.column("doc_id").cast(pa.int64())
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)[rows[has]]
            keep[has] = (known[at] != mine) | (keeper[at] == own) | ids.is_null().to_numpy(zero_copy_only=False)[rows[has]]
        return keep

    return _drop(docs, stays, with_text)


def _drop_joined(docs: DataFrame, lost: DataFrame, with_text: bool) -> DataFrame:
    """lost: (doc_id, keys), the keys that a document loses; no more than its lines."""
    gone = "_gone"  # a name that no column of the documents has
    while gone in map(str.lower, docs.columns):
        gone += "_"

    def stays(part: pa.RecordBatch, keys: list[bytes | None], rows: np.ndarray) -> np.ndarray:
        left_out = [set(x or ()) for x in part.column(gone).to_pylist()]
        return np.array([k is None or k not in left_out[r] for k, r in zip(keys, rows.tolist(), strict=True)], bool)

    both = docs.join(lost.select("doc_id", F.col("keys").alias(gone)), "doc_id", "left").select(*docs.columns, gone)
    return _drop(both, stays, with_text, gone)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """Drops repeated lines of one table of documents, which a store takes in batches."""
    store = LineStore(docs.sparkSession)
    posted = cut(postings(docs))
    for k in range(batches):
        store.add_postings(posted.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), unseen=True)
    kept = store.apply(docs, min_docs, with_text)
    remove(docs.sparkSession, store.folder)  # what apply needs of it is sent or kept apart
    return kept


class LineStore:
    """Line dedup over documents that are added and removed; every step can be undone by its opposite.

    Tables in ``folder``: postings, removed documents, references and filters, as rows with the version of the change that
    wrote them, and a state that is written last, so that a change that fails part-way has not happened.
    """

    TABLES = {"postings": "key binary, doc_id long, version long", "removed": "doc_id long, version long", "references": "key binary, n_docs long, keeper long, version long", "filters": f"{_FILTER}, version long"}

    def __init__(self, spark: SparkSession, folder: str | None = None, capacity: int = KEYS_PER_SHARD, shards: int = FIRST_SHARDS):
        self.spark, self.capacity = spark, capacity
        self.folder = folder or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.version, self.shards = 0, shards
        self.paths: dict[str, list[str]] = {t: [] for t in self.TABLES}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineStore:
        """The store in a folder, as its last whole change left it."""
        row = spark.read.parquet(f"{folder}/state/*").orderBy(F.desc("version")).first()
        store = cls(spark, folder, row["capacity"])
        store.version, store.shards, store.paths = row["version"], row["shards"], {t: list(row["paths"][t]) for t in cls.TABLES}
        return store

    def _rows(self, table: str) -> DataFrame:
        paths = self.paths[table]
        return self.spark.read.schema(self.TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[table])

    def _append(self, table: str, rows: DataFrame) -> None:
        path = f"{self.folder}/{table}/{self.version}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("version", F.lit(self.version).cast("long")).select([c.split()[0] for c in self.TABLES[table].split(", ")]).write.parquet(path)
        self.paths[table] = [*self.paths[table], path]

    def _commit(self) -> None:
        if max(len(p) for p in self.paths.values()) > MOST_VERSIONS:
            self._merge()
        state = self.spark.range(1).select(F.lit(self.version).cast("long").alias("version"), F.lit(self.shards).alias("shards"), F.lit(self.capacity).alias("capacity"), F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(p) for p in x]).cast("array<string>") for t in self.paths.items() for x in t]).alias("paths"))
        state.coalesce(1).write.parquet(f"{self.folder}/state/{self.version}-{uuid.uuid4().hex[:8]}")

    def _merge(self) -> None:
        """One version of each table; older files stay for those who still read them."""
        now = {"postings": self.postings(), "references": self.references(), "filters": self.filters()}
        self.paths |= {t: [] for t in self.TABLES}
        for table, rows in now.items():
            self._append(table, rows)

    def postings(self) -> DataFrame:
        """(key, doc_id) of the documents that the store holds."""
        rows = self._rows("postings")
        if not self.paths["removed"]:
            return rows.select("key", "doc_id")
        last = self._rows("removed").groupBy("doc_id").agg(F.max("version").alias("gone"))
        return rows.join(last, "doc_id", "left").where("gone IS NULL OR version > gone").select("key", "doc_id")

    def references(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, n_docs, keeper) of all keys, or of these, that some document holds."""
        rows = self._rows("references")
        if keys is not None:
            rows = by_ids(rows, keys.select("key"), "left_semi", "key")
        if len(self.paths["references"]) > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("n_docs", "keeper"), "version").alias("last")).select("key", "last.*")
        return rows.where("n_docs > 0").select("key", "n_docs", "keeper")

    def filters(self) -> DataFrame:
        """(shard, filter, n_keys)."""
        return self._rows("filters").groupBy("shard").agg(F.max_by(F.struct("filter", "n_keys"), "version").alias("last")).select("shard", "last.*")

    def _make_room(self, more: int) -> None:
        """Doubles the shards until each has room for the keys that may come; then the filters are built anew."""
        total = (self._rows("filters").groupBy("shard").agg(F.max_by("n_keys", "version").alias("n")).agg(F.sum("n")).first()[0] or 0) + more
        shards = self.shards
        while shards * self.capacity < total:
            shards *= 2
        if shards > self.shards:
            self.shards, known = shards, self.paths["references"]
            self.paths["filters"] = []
            if known:
                self._append("filters", _changed(self.references(), self.filters(), shards, self.capacity, True))

    def add(self, docs: DataFrame) -> None:
        """Documents whose doc_id the store already holds are not added again."""
        self.add_postings(cut(postings(docs)))

    def add_postings(self, posted: DataFrame, unseen: bool = False) -> None:
        """posted: (key, doc_id) of documents, repeats allowed. unseen: the store is known to hold none of these documents."""
        self.version += 1
        new = posted.dropDuplicates(["key", "doc_id"])
        if self.paths["postings"] and not unseen:
            held = by_ids(self.postings(), posted.select("doc_id").distinct(), "left_semi").select("doc_id").distinct()
            new = by_ids(new, held, "left_anti")
        self._append("postings", new)
        counted = cut(references(self.spark.read.parquet(self.paths["postings"][-1])))
        self._make_room(counted.count())
        probed = cut(_probed(counted, self.filters(), self.shards, self.capacity))
        perhaps = probed.where("perhaps").select("key", "n_docs", "keeper")
        fresh = probed.where("NOT perhaps").select("key", "n_docs", "keeper")
        after = probed.where("filter IS NOT NULL").select("shard", "filter", "n_keys")
        known = self.references(perhaps).select("key", F.col("n_docs").alias("before"), F.col("keeper").alias("last"))
        merged = cut(perhaps.join(known, "key", "left").select("key", (F.col("n_docs") + F.coalesce("before", F.lit(0))).alias("n_docs"), F.greatest("keeper", "last").alias("keeper"), F.col("before").isNull().alias("new")))
        mistaken = merged.where("new")  # the filter was wrong: they are new and must enter it too
        self._append("references", fresh.unionByName(merged.drop("new")))
        self._append("filters", after if mistaken.isEmpty() else _changed(mistaken, after, self.shards, self.capacity, True))
        self._commit()

    def remove(self, doc_ids: DataFrame) -> None:
        """Takes documents out; ids that the store does not hold are ignored."""
        gone = cut(by_ids(self.postings(), doc_ids.select(F.col("doc_id").cast("long")).distinct(), "left_semi"))
        self.version += 1
        self._append("removed", gone.select("doc_id").distinct())
        touched = cut(gone.select("key").distinct())
        renewed = cut(touched.join(references(_of_keys(self.postings(), touched)), "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "keeper"))
        self._append("references", renewed)
        self._append("filters", _changed(renewed.where("n_docs = 0"), self.filters(), self.shards, self.capacity, False))
        self._commit()

    def apply(self, docs: DataFrame, min_docs: int = MIN_DOCS, with_text: bool = False) -> DataFrame:
        """The store's present counts applied to documents that it holds; a document that it does not hold loses what it
        would lose if a larger doc_id had the key. With text, the row's own columns stay."""
        busy = cut(self.references().where(F.col("n_docs") >= min_docs))
        if busy.count() <= SENT_KEYS:
            return _drop_sent(docs, busy.select("key", "keeper"), with_text)
        held = salted_join(self.postings(), busy.select("key", "keeper"), "key", "doc_id", busy.select("key", F.col("n_docs").alias("n")))
        lost = held.where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
        return _drop_joined(docs, cut(lost), with_text)
