"""MinHash near-dedup with SuperMinHash signatures, banding, exact verification and union-find grouping.

SuperMinHash gives each shingle a random permutation of the signature's slots; the shingle visits slot p[j] with the
value j + r, so that its values are correlated ranks, which lowers the variance of the similarity estimate. Once each
slot of a text holds a value below j, later steps cannot change it and the text stops; long texts stop after one step.

Texts with equal shingle sets form one class by a digest of the set, so exact copies cost no pairs. Classes are the nodes
of all that follows. Each class's signature is cut into bands. A bucket (band, hash) compares its members with one of
them, its hub, only; buckets choose hubs by a hash, so a group of near copies has many. Pairs are first held against the
signatures (a pair six standard deviations below the threshold is left out), then against the full sets, and verified
links are grouped. A link between two members of a bucket may still be missed if neither is the hub; so buckets that then
hold several components are looked at again, each by itself, as texts that are only somewhat alike hang together through
their buckets over much of a corpus. Those outside a bucket's largest component meet each other and it, in blocks of about
``BLOCK`` x ``BLOCK``; so a member of a bucket of usual size is dealt out twice at most. Buckets of more than ``MANY`` blocks
are first put together as regions, and there only those meet that share one of the seldom shingles by which they differ from
the region's centre (``centred``), which similar ones must. Members come with their sets, folded to 16 bits a shingle; a
matrix product counts the common values of all pairs,
and only pairs that the counts cannot rule out leave the task for verification. With b bands of r rows a link at
similarity s is no candidate with probability (1 - s^r)^b: 7e-9 at 0.85 with 32 bands of 5, 3e-6 at 0.8.

Keys that many rows share, such as the hub of a large group, a bucket, or the digest of a text with many copies, are
salted (``salted_join``), so no join gathers them in one task.

Null and empty texts and those without words have no shingles, link with nothing and stay alone. Rows with a null doc_id
link with nothing, have a null component_id and are kept. Rows that repeat a doc_id are judged by their own texts. Other
columns are ignored, whatever their names. Ids stand for texts only in joins; nothing is collected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm import centred
from terradelta.llm import shingles as S
from terradelta.llm.shared import by_ids, cut, salted_join, tidy, worker_state
from terradelta.operators.graph import stars

BANDS, ROWS = 32, 5
#: Members of a bucket are compared in blocks of about so many; buckets of more than ``MANY`` blocks go another way.
BLOCK, MANY = 1024, 8
#: Values of folded sets that are counted at once.
WIDTH = 2048


def superminhash(hashes: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, step * 2**32 + random part, of sets given by all their hashes and offsets; empty sets keep the maximum."""
    docs = len(at) - 1
    sig = np.full(docs * slots, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    doc = np.repeat(np.arange(docs), np.diff(at))

    def draw(h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        x = S.mix(h + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return x >> np.uint64(32), (step + ((x & low) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64))

    value, place = draw(hashes, 0)
    np.minimum.at(sig, doc * slots + place, value)
    grid = sig.reshape(docs, slots)
    open_docs = (grid >= np.uint64(1 << 32)).any(1)
    use = np.flatnonzero(open_docs[doc])
    h, d = hashes[use], doc[use]
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
    row = np.arange(len(h))
    perm[row, place[use]] = 0
    perm[:, 0] = place[use]
    for step in range(1, slots):
        if not len(h):
            break
        value, k = draw(h, step)
        place = perm[row, k]
        perm[row, k] = perm[:, step]
        perm[:, step] = place
        np.minimum.at(sig, d * slots + place, value + np.uint64(step << 32))
        still = np.zeros(docs, bool)
        left = np.unique(d)
        still[left] = (grid[left] >= np.uint64(step + 1 << 32)).any(1)
        keep = still[d]
        if not keep.all():
            h, d, perm = h[keep], d[keep], perm[keep]
            row = np.arange(len(h))
    return grid


def signatures(docs: DataFrame, size: int, slots: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, sig): the set's size, a digest of it, and a byte for each slot of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("shingles")
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                sets = list(S.distinct(*S.shingles(data, at, size)))
                n = np.array([len(x) for x in sets])
                sig = superminhash(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]), slots)
                short = (S.mix(sig) >> np.uint64(56)).astype(np.uint8)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                raw = [x.tobytes() if k else None for x, k in zip(short, n, strict=True)]
                own = [b.column(k).slice(lo, hi - lo) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "sig"])

    return _keyed(docs).mapInArrow(tidy(run), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): which row a text is from, also where a doc_id has several texts."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of these classes, perhaps more than once."""
    wanted = classes.select("id", "doc_id", "text_hash").join(ids, "id", "left_semi")
    return by_ids(_keyed(docs), wanted, "inner", "doc_id", "text_hash").select("id", "text")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, items) of (id, text): each text's sorted distinct shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("sets")
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                sets = [x.tobytes() for x in S.distinct(*S.shingles(data, at, size))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "items"])

    return texts.mapInArrow(tidy(run), "id long, items binary").dropDuplicates(["id"])


def _likely(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` slots at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (2, 3))
                yield b.select([0, 1]).filter(pa.array((one == two).sum(1) >= least))

    return _with_both(pairs, sigs, "sig").mapInArrow(tidy(run), "a long, b long")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, a_column, b_column): pairs with a column of both their rows of a table by id."""
    named = lambda side: table.select(F.col("id").alias(side), F.col(column).alias(f"{side}_{column}"))
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    one = salted_join(pairs, named("b"), "b", "a")
    return salted_join(one, named("a"), "a", "b", sizes).select("a", "b", f"a_{column}", f"b_{column}")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pairs")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                good = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([one, two]))
                    common = int((both[1:] == both[:-1]).sum())
                    good.append(100 * common >= percent * (len(one) + len(two) - common))
                yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = cut(shingle_sets(_texts(docs, classes, ids), size))
    return _with_both(pairs, sets, "items").mapInArrow(tidy(run), "a long, b long")


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition's links: (a, b) with b the smallest id that a reaches here."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for p in parts:
        for a, b in zip(p["a"].tolist(), p["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id with a link, the smallest id it reaches.

    Each partition first shrinks its links to a forest by union-find; the forests are then contracted to stars.
    """
    edges = stars(links.mapInPandas(_forest, "a long, b long"))
    roots = edges.select("b").distinct().select(F.col("b").alias("a"), "b")
    return edges.union(roots).select(F.col("a").alias("id"), F.col("b").alias("component"))


def folded_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, folded) of (id, text): the size of each text's shingle set, and the set folded to 16 bits a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in S.texts(b.column(1)):
                sets = list(S.distinct(*S.shingles(data, at, size)))
                raw = [np.unique((x >> np.uint64(48)).astype(np.uint16)).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(raw, pa.binary())], ["id", "n", "folded"])

    return texts.mapInArrow(tidy(run), "id long, n long, folded binary").dropDuplicates(["id"])


def _possible(rows: dict[str, list], percent: int) -> list[tuple[int, int]]:
    """Of one block pair's rows: the pairs in different components that may be similar enough.

    Folding keeps each shingle's value, so the symmetric difference of folded sets is no larger than the sets' own; and
    that of similar sets is at most (100 - percent) / (100 + percent) of their sizes' sum. No similar pair is ruled out.
    """
    component, side, n = (np.array(rows[c]) for c in ("component", "side", "n"))
    one = np.flatnonzero(side != 0)
    two = one if side.min() == 2 else np.flatnonzero(side == 0)
    apart = component[one][:, None] != component[two][None, :]
    if two is one:
        apart &= np.tri(len(one), k=-1, dtype=bool)
    if not apart.any():
        return []
    sets = [np.frombuffer(x, np.uint16) for x in rows["folded"]]
    length = np.array([len(x) for x in sets])
    times = np.zeros(1 << 16, np.int32)
    for x in sets:
        times[x] += 1
    place = np.cumsum(times > 1, dtype=np.int32) - 1  # a value that one set has is common to no pair
    sets = [place[x[times[x] > 1]] for x in sets]
    row, column = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets]), np.concatenate(sets)
    common = np.zeros(apart.shape, np.float32)
    for lo in range(0, int(place[-1]) + 1, WIDTH):
        here = np.flatnonzero((column >= lo) & (column < lo + WIDTH))
        grid = np.zeros((len(sets), min(WIDTH, int(place[-1]) + 1 - lo)), np.float32)
        grid[row[here], column[here] - lo] = 1
        common += grid[one] @ grid[two].T
    differ = length[one][:, None] + length[two][None, :] - 2 * common
    a, b = np.nonzero(apart & (differ * (100 + percent) <= (n[one][:, None] + n[two][None, :]) * (100 - percent)))
    ids = rows["id"]
    return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(one[a].tolist(), two[b].tolist(), strict=True)]


def _cross_pairs(mixed: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket that lie in different components and may be similar enough.

    mixed: (bucket, id, component, members, major, outside) of buckets with several components; major is the bucket's
    largest component and outside the number of members that are not in it. Members outside are dealt to blocks, and so
    are those inside; each pair of blocks that has some outside is a cell.
    """
    out = F.col("component") != F.col("major")
    outer, inner = F.ceil(F.col("outside") / BLOCK), F.ceil((F.col("members") - F.col("outside")) / BLOCK)
    mine = F.pmod(F.xxhash64("id"), F.when(out, outer).otherwise(inner))
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    among = F.transform(blocks(outer), lambda j: cell(0, F.least("mine", j), F.greatest("mine", j), F.when(F.col("mine") == j, 2).when(F.col("mine") < j, 0).otherwise(1)))
    across = F.transform(blocks(inner), lambda j: cell(1, F.col("mine"), j, F.lit(1)))
    within = F.transform(blocks(outer), lambda j: cell(1, j, F.col("mine"), F.lit(0)))
    placed = mixed.withColumn("mine", mine).withColumn("cell", F.explode(F.when(out, F.concat(among, across)).otherwise(within)))
    keyed = placed.select(F.xxhash64("bucket", "cell.kind", "cell.x", "cell.y").alias("key"), "cell.side", "id", "component")
    sets = folded_sets(_texts(docs, classes, mixed.select("id").distinct()), size)
    names = ["id", "component", "side", "n", "folded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {c: [] for c in names}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                keys = b.column("key").to_numpy()
                columns = {c: b.column(c).to_pylist() for c in names}
                edge = np.flatnonzero(np.diff(keys)) + 1
                found = []
                for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)], strict=True):
                    if keys[lo] != key:
                        if len(held["id"]) > 1:
                            found += _possible(held, percent)
                        key, held = keys[lo], {c: [] for c in names}
                    for c in names:
                        held[c] += columns[c][lo:hi]
                yield pairs(found)
        if len(held["id"]) > 1:
            yield pairs(_possible(held, percent))

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        found = sorted(set(found))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    # A key has at most a block from each side: about 2 * BLOCK rows.
    dealt = keyed.join(sets, "id").select("key", *names).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _mixed(labelled: DataFrame, least: int) -> DataFrame:
    """Of (bucket, id, component): the rows of buckets with ``least`` members or more in several components, with the
    bucket's members, its major (largest) component, the members outside of it, and its lowest id."""
    kinds = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min("id").alias("low")).groupBy("bucket")
    several = kinds.agg(F.sum("n").alias("members"), F.max_by("component", F.struct("n", "component")).alias("major"), (F.sum("n") - F.max("n")).alias("outside"), F.min("low").alias("low"))
    several = cut(several.where((F.col("outside") > 0) & (F.col("members") >= least)))
    return cut(salted_join(labelled, several, "bucket", "id", several.select("bucket", F.col("members").alias("n"))))


def _thinned(mixed: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows as of ``_mixed`` in place of mixed ones, such that no link within a bucket is lost, and (a, b), links, or None.

    Buckets of more than ``MANY`` blocks that share members form a region, whose members only meet where
    ``centred.meetings`` cannot tell them apart; all other buckets stay as they are.
    """
    many = F.col("members") > MANY * BLOCK
    crowded = mixed.where(many)
    if crowded.isEmpty():
        return mixed, None
    own = crowded.select("id", "component").distinct()
    regions = components(crowded.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "region")
    placed = cut(regions.join(own, "id"))
    sizes = cut(placed.groupBy("region").agg(F.count("*").alias("n")))
    members = cut(salted_join(placed, sizes, "region", "id", sizes))
    sets = cut(shingle_sets(_texts(docs, classes, members.select("id")), size))
    apart, links = centred.meetings(members, sets, percent)
    return mixed.where(~many).unionByName(_mixed(cut(apart), 2)), links


def _buckets(sigs: DataFrame, count: int, rows: int) -> DataFrame:
    """(bucket, id): a hash for each band of each signature."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * rows + 1, F.lit(rows))))
    return sigs.select(F.explode(hashed).alias("bucket"), "id")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each row: links are similarities of ``percent`` or more.

    component_id is the least doc_id that a row's text reaches; text_hash is Spark's xxhash64 of the text.
    """
    slots, share = bands * rows, percent / 100
    least = math.floor(slots * (share - 6 * math.sqrt(share * (1 - share) / slots)))
    signed = cut(signatures(docs, size, slots))
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    grouped = signed.where(usable).groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.any_value("sig").alias("sig"), F.count("*").alias("n"))
    classes = cut(grouped.select("digest", "row.doc_id", "row.text_hash", "sig", "n", F.monotonically_increasing_id().alias("id")))
    sigs = classes.select("id", "sig")
    banded = _buckets(sigs, bands, rows)
    hub = F.min_by("id", F.xxhash64("bucket", "id")).alias("hub")
    hubs = cut(banded.groupBy("bucket").agg(hub, F.count("*").alias("n")).where("n > 1"))  # buckets with several members
    shared = cut(salted_join(banded, hubs.select("bucket", "hub"), "bucket", "id", hubs.select("bucket", "n")))
    star = cut(shared.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct())
    links = cut(_verified(cut(_likely(star, sigs, least)), docs, classes, size, percent))
    found = components(links)
    labelled = cut(shared.select("bucket", "id").join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")))
    mixed = _mixed(labelled, 3)
    near, sure = _thinned(mixed, docs, classes, size, percent)
    more = _verified(cut(_cross_pairs(near, docs, classes, size, percent)), docs, classes, size, percent)
    more = cut(more if sure is None else more.union(sure))
    if not more.isEmpty():
        found = components(links.union(more))
    linked = cut(found.join(classes.select("id", "doc_id"), "id"))
    lows = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = salted_join(linked.select("id", "component"), lows, "component", "id").select("id", "component_id")
    by_class = classes.join(named, "id", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    ours = salted_join(signed.where(usable), by_class, "digest", "doc_id", classes.select("digest", "n"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    alone = signed.where(~usable).withColumn("component_id", F.col("doc_id"))
    return ours.select(columns).unionByName(alone.select(columns)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
