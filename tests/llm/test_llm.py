"""The llm operators against brute-force versions, on rows with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terradelta.llm import audio, bpe, decontaminate, language_id, line_dedup, minhash, quality, registry, shared, token_counts, url_filter, warc
from terradelta.llm import shingles as S

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\n\v\f\r"


def docs(spark, texts, first=0, **more):
    """Documents with clashing extra columns."""
    rows = [(i if i is None else i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for c in ("keys", "n_lines", "id", "digest", "score", "component_id", "n_tokens", "keep"):
        df = df.withColumn(c, F.lit(more.get(c, "x")))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(1, 60))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(6):
            v = list(b)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(v).upper() if rng.random() < 0.2 else " ".join(v))
    texts += [None, "", " \n ", "one", "One", "one two", texts[0], texts[0] + " \t", "long " * 30000]
    return texts


# --- 10 and 8: tokens ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken

    t = bpe.tokenizer()
    return t, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


def messy(rng, n):
    return "".join(rng.choice(" \n\t  abAB'sré.,!9ß漢🙂\r\x85\u3000'rell") for _ in range(n))


def test_bpe_is_the_public_library_s(reference_encoding):
    t, ref = reference_encoding
    rng = random.Random(1)
    texts = [messy(rng, rng.randint(0, 300 if k % 10 == 0 else 30)) for k in range(4000)] + ["ab" * 20000, "", "<|endoftext|>"]
    for lo in range(0, len(texts), 500):
        for s, (n, ids, raw) in zip(texts[lo : lo + 500], t.digests(texts[lo : lo + 500]), strict=True):
            want = ref.encode_ordinary(s)
            assert (n, ids, raw) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(s.encode()).hexdigest()), s
            if s:
                assert t.encode(s) == want and t.decode(want) == s.encode()


def test_bpe_merges_alone_and_together(reference_encoding):
    t, ref = reference_encoding
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdehinrst") for _ in range(rng.randint(1, 64))) for _ in range(300)]
    ids, n = t.merge_all(pieces, 64)
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [bpe.merge(p, t.ranks) if p not in t.ranks else ids[a:b].tolist() for p, a, b in zip(pieces, at[:-1], at[1:], strict=True)]


def test_bpe_of_odd_rows(spark, corpus):
    df = docs(spark, [None, "", "a b", "a b"])
    got = bpe.encode_digests(df).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest() and got[2].ids_sha256 == got[3].ids_sha256
    assert bpe.encode_digests(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(docs(spark, corpus[:50]))).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == corpus[:50]


def test_edits_count_as_full_encoding(reference_encoding, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    monkeypatch.setattr(token_counts, "FULL", 12)
    t, ref = reference_encoding
    rng = random.Random(3)
    for _ in range(800):
        s = messy(rng, rng.randint(0, 60))
        tree = token_counts.TokenTree(t, t.find(s))
        for _ in range(4):
            a = rng.randint(-2, len(s) + 3)
            b, new = a + rng.choice([0, 0, 1, 3, 30]), messy(rng, rng.choice([0, 1, 2, 10, 40]))
            lo = min(max(0, a), len(s))
            s = s[:lo] + new + s[min(max(lo, b), len(s)) :]
            tree.edit(a, b, new)
            assert tree.text == s and tree.n_tokens == len(ref.encode_ordinary(s))


def test_an_edit_touches_few_pretokens(reference_encoding):
    t, _ = reference_encoding
    tree = token_counts.TokenTree(t, t.find("word and " * 20000))
    assert tree.edit(90000, 90004, "other") < 300


def test_edited_counts_of_odd_rows(spark):
    df = docs(spark, [None, "", "ab cd"]).select("doc_id", "text", F.expr("CASE WHEN doc_id = 2 THEN array(named_struct('start', 2L, 'end', 99L, 'text', cast(NULL AS string))) END AS edits"))
    df = df.withColumn("n_tokens", F.lit("x")).withColumn("tree", F.lit(1))
    assert [(r.n_tokens > 0, r.n_tokens_edited > 0) for r in token_counts.edited_counts(df).orderBy("doc_id").collect()] == [(False, False), (False, False), (True, True)]
    assert token_counts.edited_counts(df.limit(0)).count() == 0
    twice = token_counts.edited_counts(df.union(df)).where("doc_id = 2").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


# --- 6: near duplicates ----------------------------------------------------------------------------------------------
def brute_components(texts, size, percent):
    sets = [shingle_set(t, size) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 512), (5, 80, 4)])
def test_near_duplicates_are_all_pairs_components(spark, corpus, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(docs(spark, corpus), size, percent).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == brute_components(corpus, size, percent)


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    base = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-3000])), (3, " ".join(base[:20_000])), (4, "same " * 100_000), (5, "same " * 90_000)]
    got = minhash.near_duplicates(docs(spark, [None]).limit(0).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 59_998, 1), (2, 56_998, 1), (3, 19_998, 3), (4, 1, 4), (5, 1, 4)]


def test_each_text_of_a_repeated_doc_id_is_judged(spark):
    one, two, alone = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(5, one), (5, two), (3, one + " x"), (7, two + " x"), (7, alone), (2, "y " + one)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2, True), (3, 2, False), (5, 2, False), (5, 5, True), (7, 5, False), (7, 7, True)]


@pytest.mark.parametrize("edits", [2, 4])
def test_a_large_group_near_the_threshold_loses_no_link(spark, monkeypatch, edits):
    """One text in 1500 versions of which each differs in a few words: many pairs are just above or just below 85 %."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for _ in range(1500):
        v = list(base)
        for k in rng.sample(range(len(v)), edits):
            v[k] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(v))
    sets = [sorted({hash(s) for s in shingle_set(t, 3)}) for t in texts]
    place = {h: i for i, h in enumerate(sorted({h for s in sets for h in s}))}
    grid = np.zeros((len(texts), len(place)), np.float32)
    for i, s in enumerate(sets):
        grid[i, [place[h] for h in s]] = 1
    common, n = grid @ grid.T, grid.sum(1)
    linked = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
    low, before = np.arange(len(texts)), None
    while before is None or (low != before).any():
        before, low = low, np.where(linked, low[None, :], len(texts)).min(1)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 3, 85).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == low.tolist()


@pytest.mark.parametrize("edits", [8, 16])
def test_a_group_somewhat_alike_costs_no_more_rows_than_its_buckets(spark, monkeypatch, edits):
    """One text in 1200 versions, hardly two of which are similar enough: each member is dealt out a few times a bucket."""
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(140)]
    texts = []
    for k in range(1200):
        v = list(base)
        for i in rng.sample(range(len(v)), edits):
            v[i] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(v) + " y" * (k == 7))
    texts.append(texts[7] + " y")
    rows, keep = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: (rows.append(keep(df)), rows[-1])[1])
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got}[1200] == 7
    assert max(x.count() for x in rows) <= minhash.BANDS * len(texts)


@pytest.mark.parametrize("key", ["k", "encode(k, 'utf-8')", "named_struct('k', k)"])
def test_rows_with_hot_keys_meet_one_table_only(spark, key):
    """Hot keys reach tasks as constants: no join but the one with the other table sees the large table's rows."""
    big = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 16 == 1, "b").when(F.col("id") % 99 == 0, "c").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"), "id").withColumn("k", F.expr(key))
    small = big.groupBy("k").agg(F.max("id").alias("v"))
    small = spark.createDataFrame(small.where("v % 5 < 4").collect(), small.schema)
    got = shared.salted_join(big, small, "k", "id")
    want = big.join(small, "k")
    assert got.columns == ["k", "id", "v"] and got.count() == want.count() and got.exceptAll(want).isEmpty()
    joins = [x for x in got._jdf.queryExecution().analyzed().toString().splitlines() if "Join " in x]
    assert len(joins) == 1 and "Inner" in joins[0]


def test_checkpoints_leave_no_shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    files = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    shuffles = lambda: {x.getName() for x in files() if x.getName().startswith("shuffle_")}
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    df.count()
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = [shared.cut(df, estimate).join(shared.cut(df), "k") for estimate in (True, False)]
    end = time.time() + 20  # files go a little later, those of other tests too
    while (left := shuffles() - before) and time.time() < end:
        time.sleep(0.2)
    assert before and not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert [x.count() for x in rows] == [7, 7] and df.count() == 7


def test_hot_keys_are_dealt_to_several_tasks(spark):
    big = spark.range(20000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(19000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    got = shared.salted_join(big, small, "k", "id")
    assert got.columns == ["k", "id", "v"] and got.count() == 10000 + 9500 and got.where("v <> 3 * k").isEmpty()
    assert shared.salted_join(big.limit(0), small, "k", "id").count() == 0
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        parts = shared.salted_join(big, small, "k", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in parts) < 8000


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (20, 200, 2000):
        x = rng.integers(0, 1 << 62, n + n // 5).astype(np.uint64)
        errors = []
        for k in range(20):
            a, b = x[:n] ^ np.uint64(k), x[n // 5 :] ^ np.uint64(k)
            g = minhash.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 160)
            errors.append((g[0] == g[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05


# --- 1: decontamination ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_containment_is_exact_both_ways(spark, corpus, limit):
    rng = random.Random(8)
    items = [t for t in corpus if t and 3 < len(words(t)) < 60][:25] + [None, "", "one"]
    texts = [f"{' '.join(rng.choices(corpus[:10], k=3))} {i} {corpus[3]}" for i in items[:12]] + corpus
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("sketch", F.lit(1))
    got = {(r.doc_id, r.item_id): r.n_common for r in decontaminate.contained(docs(spark, texts), df, item_bytes=limit).collect()}
    want = {}
    for j, item in enumerate(items):
        s = shingle_set(item, 5)
        for i, t in enumerate(texts):
            n = len(s & shingle_set(t, 5))
            if s and n >= 0.8 * len(s) - 1e-9:
                want[i, j] = n
    assert got == want and len(want) > 20


def test_containment_in_very_long_and_repeated_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    long = "filler words without end " * 100_000
    df = docs(spark, [long + item + " " + long, item, item, None]).union(docs(spark, [item], first=1))
    items = spark.createDataFrame([(1, item), (1, item), (2, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_common) for r in decontaminate.contained(df, items).collect()) == [(0, 1, 6), (1, 1, 6), (2, 1, 6)]
    assert decontaminate.contained(df.limit(0), items).count() == 0 == decontaminate.contained(df, items.limit(0)).count()


def test_sketches_leave_room_for_misses():
    for n in range(1, 500):
        assert decontaminate.sketch_size(n, 0.8) > n - -(-n * 4 // 5)


# --- 2: lines --------------------------------------------------------------------------------------------------------
def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANK))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    pool = [f"this is the shared line number {k} é" for k in range(8)] + ["short", "", "  This IS the shared line number 3 É \r", "exactly twenty chars"]
    return [(i, rng.choice(["\n", "\r\n"]).join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(60)] + [(60, None), (61, ""), (5, pool[0])]


def collected(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_lines_of_three_documents_stay_once(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT_KEYS", sent)
    rows = line_rows()
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").withColumn("_gone", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    want = brute_lines(rows)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == want and [x[2] for x in got if x[0] is None] == [0]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    texts = line_dedup.dedup_lines(df.withColumn("_gone_", F.lit(2)), with_text=True)
    assert texts.columns == ["doc_id", "text", "_gone", "key", "_gone_"] and texts.where("_gone = 'x' AND _gone_ = 2").count() == len(rows) + 1
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts.collect() if r.doc_id is not None) == sorted((x[0], x[3]) for x in want)


def test_very_long_texts_lose_lines(spark):
    line = "a line that stands in every one of these documents"
    rows = [(i, "\n".join([line, *(f"line {k} of document {i} stands alone" for k in range(20000)), line, "x" * 300_000])) for i in range(3)]
    assert collected(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_lines(rows)


@pytest.mark.parametrize("most", [16, 2])
def test_line_store_is_reversible(spark, monkeypatch, most):
    """Shards for four keys each, so that the store is resharded; with two versions, its tables are merged on the way."""
    monkeypatch.setattr(line_dedup, "MOST_VERSIONS", most)
    rows = [r for r in line_rows() if r[0] != 5]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string").coalesce(1)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "doc_id long").coalesce(1)
    extra = [(200 + k, f"a line that only document {k // 2} and its twin have") for k in range(40)]
    store = line_dedup.LineStore(spark, capacity=4, shards=1)
    store.add(frame(rows[:30]))
    first = store.shards
    store.add(frame(rows[30:]))
    before = sorted((bytes(r.key), r.n_docs, r.keeper) for r in store.references().collect())
    assert collected(store.apply(frame(rows))) == brute_lines(rows)
    store.add(frame(extra + rows[:3]))  # the last are there already
    assert store.shards > first >= 1 and store.shards * store.capacity >= store.references().count()
    store = line_dedup.LineStore.open(spark, store.folder)
    assert collected(store.apply(frame(rows + extra))) == brute_lines(rows + extra)
    store.remove(ids([i for i, _ in extra] + [999]))
    assert sorted((bytes(r.key), r.n_docs, r.keeper) for r in store.references().collect()) == before
    gone = {3, 8, 59, 61}
    store.remove(ids(gone))
    left = [r for r in rows if r[0] not in gone]
    assert collected(store.apply(frame(left))) == brute_lines(left)
    store.add(frame([r for r in rows if r[0] in gone]))
    assert collected(store.apply(frame(rows))) == brute_lines(rows)
    assert sorted((bytes(r.key), r.n_docs, r.keeper) for r in store.references().collect()) == before
    known = store.references().select("key", F.pmod(F.xxhash64("key"), F.lit(store.shards)).alias("shard")).collect()
    filters = {r.shard: line_dedup.CuckooFilter.load(r.filter) for r in store.filters().collect()}
    assert all(filters[r.shard].contains([bytes(r.key)])[0] for r in known) and sum(f.size() for f in filters.values()) == len(known)


def test_cuckoo_filter_loses_nothing_and_forgets():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    for capacity in (5000, 200):  # the second overflows to the stash
        f = line_dedup.CuckooFilter(capacity)
        f.add(keys[:4000])
        f = line_dedup.CuckooFilter.load(f.dump())
        assert f.contains(keys[:4000]).all()
        assert f.contains(keys[4000:]).mean() < 0.01
        f.remove(keys[:2000])
        assert f.contains(keys[2000:4000]).all() and f.contains(keys[:2000]).mean() < 0.01


# --- 3: URLs ---------------------------------------------------------------------------------------------------------
def test_url_rules_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "A.com", "xa.com", "net", "a-b.com", ""]
    paths = ["", "/", "/en/", "/en", "/en/x", "/e", "/é/", "/en/x/y"]
    rules = sorted({(rng.choice(hosts[:6]).lower(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(14)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x'])}" for s in ("http://", "https://", "x") for _ in range(60)] + [None, "", "://", "http://a.com\n/en/", "a://b://c"]
    rows = [*enumerate(urls), (0, urls[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = []
    for i, u in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((i, host, path, best[2] if best else "", best[3] if best else "allow"))
    assert got == sorted(want)
    assert url_filter.filter_urls(df.limit(0), spark.sql(url_filter.RULES)).count() == 0


def test_url_rules_that_tie_and_hosts_of_many_labels(spark):
    rules = spark.createDataFrame([("a.com", "/x", "allow"), ("A.com", "/x", "block"), (None, "/", "block"), ("b.com", None, "block"), ("com", "", "allow")], "host string, path string, verdict string")
    deep = "http://" + "w." * 5000 + "a.com/x" + "y" * 20000
    pages = spark.createDataFrame([(1, "http://a.com/x1"), (1, "http://a.com/x1"), (2, "http://b.com"), (3, "http://com/x"), (4, deep), (5, "http://net/"), (None, None)], "page_id long, url string").withColumn("host", F.lit("z")).withColumn("labels", F.lit(1))
    got = sorted((r.page_id or 0, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == [(0, "", "allow"), (1, "a.com/x", "block"), (1, "a.com/x", "block"), (2, "b.com", "block"), (3, "com", "allow"), (4, "a.com/x", "block"), (5, "", "allow")]
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == 7


# --- 4: languages ----------------------------------------------------------------------------------------------------
def test_gru_gradients():
    m = language_id.ByteGru(["a", "b", "c"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = language_id.padded([b"abc", b"defgh", b"a"])
    y = np.array([0, 1, 2])
    loss = lambda: -(np.log(m.positions(x, mask)[:, np.arange(3), y]) * mask).sum() / mask.sum()
    g, rng = m.gradients(x, mask, y), np.random.default_rng(0)
    for k in m.p:
        for _ in range(10):
            at = tuple(rng.integers(0, s) for s in m.p[k].shape)
            at = (int(x[0, rng.integers(0, 3)]), at[1]) if k[0] == "x" else at
            old = m.p[k][at]
            m.p[k][at] = old + 1e-3
            up = loss()
            m.p[k][at] = old - 1e-3
            assert abs((up - loss()) / 2e-3 - g[k][at]) < 1e-4
            m.p[k][at] = old


def test_spans_label_what_the_whole_text_does(monkeypatch):
    """Spans with enough context give the sums over all positions of texts read as a whole, row by row."""
    monkeypatch.setattr(language_id, "SPAN", 20)
    monkeypatch.setattr(language_id, "CONTEXT", 60)
    monkeypatch.setattr(language_id, "ROWS", 7)
    model = language_id.ByteGru(["a", "b", "c"], hidden=5)
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abz AZ9\xc3\xa9") for _ in range(n)) for n in (1, 19, 20, 21, 40, 75, 80, 300, 0, 7)]
    got = model.sums(texts)
    for k, t in enumerate(texts):
        if t and len(t) <= 80:
            x, mask = language_id.padded([t])
            assert np.allclose(model.positions(x, mask).sum((0, 1)), got[k], atol=1e-4)
    assert np.allclose(got.sum(1), [len(t) for t in texts], atol=1e-3)
    monkeypatch.setattr(language_id, "SPAN", 1000)
    assert np.allclose(model.sums(texts), got, atol=2e-3)


def test_languages_held_out(spark):
    got = language_id.identify(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == r.lang for r in got if r.held_out]
    assert np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_an_edit_encodes_only_what_it_touches(reference_encoding):
    t, ref = reference_encoding
    long = "x" * 20000
    tree = token_counts.TokenTree(t, t.find(f"one two {long} three four"))
    seen = []
    count = tree._counts
    tree._counts = lambda block: seen.extend(block) or count(block)
    tree.edit(0, 3, "six")
    assert tree.text == f"six two {long} three four" and tree.n_tokens == len(ref.encode_ordinary(tree.text))
    assert sum(map(len, seen)) < 100


def test_a_payload_that_a_third_of_the_pages_share(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k, f"http://a/{k}", "same " * 300 if k % 3 == 0 else f"page {k} " * 200) for k in range(600)]
        got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {k: ("revisit", 597) if k % 3 == 0 and k != 597 else ("response", None) for k in range(600)}


UNKNOWN_TEXTS = {
    "Greek": "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει προς το βουνό. " * 4,
    "Chinese": "机器学习是人工智能的一个分支，它研究如何让计算机从数据中学习，而不需要明确编程。" * 4,
    "Hungarian": "A gyors barna róka átugrik a lusta kutya felett, miközben a nap lassan lenyugszik a hegyek mögött. " * 4,
    "code": "def f(x):\n    for i in range(10):\n        if x[i] != y[i + 1]:\n            return {k: v for k, v in z.items()}\n" * 4,
    "base64": "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=500)),
    "letters": "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz  ", k=500)),
}


def test_texts_of_unknown_languages_are_rejected_and_the_corpus_stays(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(known)
    kept = language_id.accept(known, model).count()
    assert kept == known.where("text RLIKE '\\\\p{L}'").count()
    foreign = docs(spark, [*UNKNOWN_TEXTS.values()])
    assert language_id.accept(foreign, model).count() == 0


def test_the_pipeline_learns_languages_from_all_documents(spark, monkeypatch):
    """Counts and bounds against numpy over every labelled document; nothing is drawn."""
    import corpus_pipeline
    from terradelta.llm import byte_pairs

    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = byte_pairs.learn(known)
    texts = {}
    for r in known.where("lang IS NOT NULL").collect():
        if any(map(str.isalpha, r.text or "")):
            texts.setdefault(r.lang, []).append(r.text)
    assert model.languages == sorted(texts) and max(map(len, texts.values())) > language_id.SAMPLE_DOCS
    for k, lang in enumerate(model.languages):
        n = np.zeros(1 << 16)
        for t in texts[lang]:
            x = np.frombuffer(t.encode(), np.uint8).astype(int)
            x[(x >= 65) & (x <= 90)] += 32
            n += np.bincount(x[:-1] * 256 + x[1:], minlength=1 << 16)
        n = n.reshape(256, 256) + byte_pairs.PRIOR * n.sum()
        assert np.allclose(model.table[:, k], np.log2(n / n.sum(1, keepdims=True)).ravel(), atol=1e-4)
        rated = [(m[k], d[k]) for m, d, size in map(model.likeness, texts[lang]) if size >= language_id.LEAST_PAIRS]
        assert np.isclose(model.floor[k], np.quantile([m for m, _ in rated], 0.005) - language_id.MARGIN) and np.isclose(model.spread[k], np.median([d for _, d in rated]))
    assert byte_pairs.accept(known, model).count() == known.where("text RLIKE '\\\\p{L}'").count()
    assert byte_pairs.accept(docs(spark, [*UNKNOWN_TEXTS.values(), None, "", "12 ++"]), model).count() == 0
    monkeypatch.setattr(language_id, "train", None)  # learns from at most SAMPLE_DOCS a language
    assert corpus_pipeline.identify_language(spark, known, "").count() == known.where("text RLIKE '\\\\p{L}'").count()


def test_languages_of_odd_rows(spark):
    model = language_id.ByteGru(["x", "y"]).fit([[b"aaa", b"aaa aaa"], [b"zzz"]], steps=30, batch=32)
    df = docs(spark, [None, "", "12 ++", "aaa aaa", "z" * 100000 + "²", "²"])
    got = [(r.lang_pred, r.score) for r in language_id.predict(df, model).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "x", "y", "und"] and got[0][1] == 0
    assert language_id.predict(df, None).where("lang_pred <> 'und'").count() == 0
    assert [r.doc_id for r in language_id.accept(df, model).orderBy("doc_id").collect()] == [3, 4]
    assert language_id.accept(df, None).count() == 6
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(unlabelled.union(unlabelled)).where("lang_pred = 'und' AND score = 0").count() == 12
    assert language_id.identify(df.limit(0)).count() == 0


# --- 5: WARC ---------------------------------------------------------------------------------------------------------
def test_warc_round_trip_of_odd_rows(spark):
    long = "é" * 20000
    rows = [(1, "u", long), (2, "u", long), (9, None, long), (9, None, long), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u\nv", "y" * 70000), (None, "u", "z" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(0))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    digest = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = sorted((p or 0, *digest(t), "revisit" if p in (1, 2) else "response", 9 if p in (1, 2) else 0) for p, _, t in rows)
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_payloads_come_back_from_segments(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    files = warc.write_archives(pages)
    read = warc.read_records(files)
    assert read.where("kind = 'continuation'").count() > 0
    back = {r.page_id: bytes(r.payload).decode() for r in warc.payloads(warc.reassemble(read)).where("kind = 'response'").collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert back == {k: html[k] for k in back} and len(back) > 10
    lost = read.where("NOT coalesce(segment = 2, false)")
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(lost).collect()
    sick = lost.withColumn("block", F.expr("CASE WHEN segment IS NULL AND page_id % 5 = 0 AND kind = 'response' THEN substring(block, 1, length(block) - 9) ELSE block END"))
    got = warc.payloads(warc.reassemble(sick, quarantine=True), quarantine=True)
    wrong = {r.record_id: r.error for r in got.where("error IS NOT NULL").collect()}
    assert any("segments missing" in e for e in wrong.values()) and not all("segments missing" in e for e in wrong.values())
    good = {r.page_id: bytes(r.payload).decode() for r in got.where("kind = 'response' AND error IS NULL").collect()}
    assert good == {k: html[k] for k in good} and len(good) + len(wrong) == len(back)


def test_a_record_of_many_segments(spark):
    html = "".join(f"<p>{i}</p>" for i in range(400_000))
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    digest = hashlib.sha1(html.encode()).hexdigest()
    assert got == [(1, len(html), digest, "revisit", 2), (2, len(html), digest, "response", None)]


def test_chunked_framing():
    for body in (b"", b"a", b"0\r\n\r\n" * 700):
        assert warc.unchunked(warc.chunked(body)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabcdeX\r\n0\r\n\r\n")


# --- 7: quality ------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, labels.where("doc_id % 4 <> 1"))
    got = quality.score(d, model).join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    good = [r.keep for r in got if r.quality == 1]
    bad = [not r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) >= 0.8


def test_quality_of_odd_rows(spark):
    df = docs(spark, [None, "", "a"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality_score for r in quality.classify(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (2, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.quality_score <= 1 for r in quality.classify(df, labels).collect())
    assert quality.classify(df.limit(0), labels).count() == 0


@pytest.mark.parametrize(("words_a_class", "least", "gain"), [(40, 0.95, -0.01), (400, 0.93, 0.03)])
def test_exchanged_labels_help(words_a_class, least, gain):
    """With 400 words a class, 24 labels show few of them; the metadata view's pseudo-labels teach the text view others."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1500)
    texts = [np.unique(rng.integers(0, words_a_class, 6) + words_a_class * k) for k in y]
    texts = [(c, np.ones(len(c)) / 2.4) for c in texts]
    meta = np.zeros((1500, quality.METADATA))
    meta[:, 0], meta[:, 9] = y + rng.normal(0, 0.4, 1500), 1
    label = np.where(np.arange(1500) < 24, y, -1)
    hit = lambda m: ((m.score(texts, meta) >= 0.5) == y)[24:].mean()
    assert hit(quality.co_train(texts, meta, label)) > max(least, hit(quality.co_train(texts, meta, label, rounds=0)) + gain)


def test_the_exchange_against_brute_force(spark):
    """Each view's least and greatest outputs, over the whole pool sorted, become labels of the other view; in the bin at
    a cut, and only there, a hash chooses."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 30))) for _ in range(900)]
    pool = quality._Pool(quality.pool_rows(docs(spark, texts).repartition(5), spark.createDataFrame([], "doc_id long, quality int")))
    gen = np.random.default_rng(2)
    models = [gen.normal(0, 1, quality.WORDS + 1), gen.normal(0, 3, quality.METADATA)]
    low, high = 90, 180
    pool.mark(models, [quality._cuts(h, low, high) for h in pool.histograms(models)])
    parts = [part for b in pool.rows.toArrow().combine_chunks().to_batches() for _, part in quality._parts(b)]
    for view in (0, 1):
        z = np.concatenate([p.outputs(models)[view] for p in parts])
        given = np.concatenate([p.given[1 - view] for p in parts])
        bins, order = quality._bins(z), np.argsort(z)
        for wanted, y, first in ((low, 0, order), (high, 1, order[::-1])):
            at = bins[first[wanted - 1]]
            surely = (bins < at) if y == 0 else (bins > at)
            assert (given[surely] == y).all() and set(bins[(given == y) & ~surely]) <= {at}
            assert abs((given == y).sum() - wanted) <= (bins == at).sum()
    pool.close()


def test_quality_of_long_and_repeated_texts(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(0, "good text"), (1, "BAD!! BAD!!"), (2, long), (2, long), (None, "good text"), (3, "good text"), (4, "good text")], "doc_id long, text string")
    got = quality.classify(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.quality_score)
    assert len(got) == 7 and len(by[2]) == 1 and by[3] == by[4] == by[None]


def test_every_unlabelled_document_is_in_the_pool(spark):
    texts = [f"word{i} is one of many" for i in range(3000)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(200, None, 0)], "doc_id long, quality int, toxic int")
    pool = quality._Pool(quality.pool_rows(docs(spark, texts).repartition(3), labels))
    models = [np.zeros(quality.WORDS + 1), np.arange(quality.METADATA) / 10]
    assert len(pool) == 2902 and (pool.histograms(models).sum(1) == 2902).all()
    low, high = 300, 500
    pool.mark(models, [quality._cuts(h, low, high) for h in pool.histograms(models)])
    got = pool.counts()  # the text view's outputs are all equal, so a hash chooses among them
    assert abs(got[1, 0] - low) < 80 and abs(got[1, 1] - high) < 100 and abs(got[0, 0] - low) < 80 and abs(got[0, 1] - high) < 100
    rows = pool.rows.toArrow().combine_chunks().to_batches()
    weight = np.array([[0.1, 0.2], [0.3, 0.4]])
    whole = [part.sums(models, weight) for b in rows for _, part in quality._parts(b)]
    for view, (loss, g) in enumerate(pool.sums(models, weight)):
        assert np.isclose(loss, sum(w[view][0] for w in whole)) and np.allclose(g, sum(w[view][1] for w in whole))
    pool.close()


def test_rare_texts_reach_the_exchange(spark):
    """Words that only 20 documents of greatest hash have get weights, though none of those documents has a label."""
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(20)], [f"BAD{i}" for i in range(20)]
    late = {r.id for r in spark.range(100, 6000).orderBy(F.xxhash64("id").desc()).limit(20).collect()}
    digits = " 1 2 3 4 5 6 7 8 9 0"
    rare = ["RAREBAD " * 12 + digits * 4, "raregood " * 12]
    df = docs(spark, [rare[i % 2] if i in late else " ".join(rng.choices(good if i % 2 else bad, k=12)) + digits * (i % 2 == 0) for i in range(6000)])
    model = quality.train(df, spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int"))
    held = [S.texts(pa.array([w])) for w in ("rarebad", "raregood")]
    weight = [model.text[quality.text_view(data, at)[0][0]][0] for run in held for _, _, data, at in run]
    assert weight[0] < 0 < weight[1]


# --- 9: audio --------------------------------------------------------------------------------------------------------
def test_resampling_keeps_a_tone():
    x = np.sin(np.arange(16000) * 2 * np.pi * 300 / 16000)
    for up, down in ((1, 4), (3, 2), (2, 3), (3, 8)):
        y = audio.resample(x, up, down)
        t = np.arange(len(y)) * down / up
        assert np.abs(y - np.sin(t * 2 * np.pi * 300 / 16000))[100:-100].max() < 0.02


def test_segments_by_hysteresis():
    e = np.array([0, 0, 3, 1.2, 1.2, 0, 0, 3, 3, 0])
    assert audio.segments(e, 0.5, -0.5) == [(2, 5), (7, 9)] and audio.segments(np.zeros(5)) == []


def test_sounds_and_tensors_are_tables(spark, tmp_path, monkeypatch):
    texts = [None, "", "a", "é" * 5000, "x" * 576]
    monkeypatch.setattr(audio, "shared_folder", lambda _: str(tmp_path))
    got = {r.doc_id: r for r in audio.text_media(docs(spark, texts)).collect()}
    (folder,) = tmp_path.iterdir()
    sounds = spark.read.parquet(f"{folder}/sounds").collect()
    assert {r.doc_id: bytes(r.media) for r in sounds} == {i: audio.wav(audio.padded((t or "").encode())) for i, t in enumerate(texts)}
    for r in spark.read.parquet(f"{folder}/tensors").collect():
        table = pa.ipc.open_stream(bytes(r.content)).read_all()
        assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [audio.SLOTS, audio.MELS])
        for row in table.drop_columns(["tensor"]).to_pylist():
            f = audio.features(audio.wav(audio.padded((texts[row["doc_id"]] or "").encode())))
            assert [(s["start"], s["end"]) for s in row["slots"]] == f["slots"] and [(s["start"], s["end"]) for s in row["segments"]] == f["segments"]
            assert got[row["doc_id"]].feature == row["feature"] == audio.feature_text(f) and np.array_equal(got[row["doc_id"]].tensor, f["tensor"].ravel())


def test_sound_is_stored_whole(spark):
    texts = [None, "", "a", "é" * 5000, "a", "x" * 576]
    got = audio.text_media(docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        raw = audio.padded((t or "").encode())
        media = audio.wav(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and len(r.tensor) == audio.SLOTS * audio.MELS
    assert got[2].feature == got[4].feature and got[0].feature == got[1].feature != got[3].feature
    assert all(len(r.slots) == audio.SLOTS and r.slots[0].start == 0 for r in got)
    with pytest.raises(ValueError):
        audio.wav_samples(b"RIFFxxxxAVI ")


def test_a_long_sound_is_read_in_blocks(spark, monkeypatch):
    raw = np.random.default_rng(3).integers(0, 256, 90_000, dtype=np.uint8).tobytes()
    media = audio.wav(audio.padded(raw))
    whole = audio.features(media)
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    assert np.array_equal(audio.features(media)["tensor"], whole["tensor"]) and audio.features(media)["segments"] == whole["segments"]
    x = np.frombuffer(audio.padded(raw), np.uint8)
    plain = audio.resample((x - 128.0) / 128)
    frames = [np.concatenate([plain, np.zeros(audio.FRAME)])[k * audio.HOP :][: audio.FRAME] * np.hanning(audio.FRAME) for k in range(whole["frames"])]
    mel = np.log(np.abs(np.fft.rfft(frames)) ** 2 @ audio._filters(audio.RATE * audio.UP / audio.DOWN) + 1e-6)
    edge = np.arange(audio.SLOTS + 1) * len(mel) // audio.SLOTS
    assert np.allclose([mel[a:b].mean(0) for a, b in zip(edge[:-1], edge[1:], strict=True)], whole["tensor"], atol=0.011)
    monkeypatch.undo()
    rows = [(1, "y" * 3_000_000), (1, "y" * 3_000_000), (None, "z")]
    got = audio.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and len({r.feature for r in got if r.doc_id}) == 1
    assert audio.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tensors_have_a_fixed_shape(spark):
    media = audio.media_of(docs(spark, ["a" * 3000, None]).select("doc_id", F.col("text").cast("binary").alias("payload")))
    found = audio.audio_features(media)
    tables = [pa.ipc.open_stream(bytes(r.content)).read_all() for r in audio.tensors_ipc(found).collect()]
    kinds = {str(t.schema.field("tensor").type) for t in tables}
    assert len(kinds) == 1 and "fixed_shape_tensor" in kinds.pop() and sum(t.num_rows for t in tables) == 2


# --- shared ----------------------------------------------------------------------------------------------------------
def test_shingles_of_odd_texts():
    texts = ["A b c d", "a  B\tc D\n", "", None, "x", "x y", "é b c d", "b c d"]
    sets = []
    for _, _, data, at in S.texts(pa.array(texts)):
        sets += [set(x.tolist()) for x in S.distinct(*S.shingles(data, at, 3))]
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1, 1, 2, 1] and sets[0] == sets[1] and sets[7] < sets[0]


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs_in.collect()}
    first = language_id.accept(docs_in, language_id.train(docs_in))
    assert first.columns == docs_in.columns
    kept = [(r.doc_id, r.text) for r in first.collect()]
    dropped = {i: n for i, _, n, _ in brute_lines(kept)}
    second = corpus_pipeline.dedup_lines(spark, first, SF)
    texts = {r.doc_id: r.text for r in second.collect()}
    assert {i: len(t.split("\n")) - len(texts[i].split("\n")) for i, t in kept if texts[i]} == {i: dropped[i] for i, _ in kept if texts[i]}
    ids = sorted(texts)
    component = brute_components([texts[i] for i in ids], 5, 80)
    alone = {ids[k] for k, c in enumerate(component) if c[2]}
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i in alone for s in items if s and len(s & shingle_set(texts[i], 5)) >= 0.8 * len(s) - 1e-9}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: hashlib.sha256(texts[i].encode()).hexdigest() for i in alone - leaks}


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    """Rows that repeat a doc_id are judged by their own texts; clashing columns, nulls and empty tables pass through."""
    import corpus_pipeline

    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two, three = (" ".join(f"{c}{i}" for i in range(50)) for c in "pqr")
    leak = "zero one two three four five six seven eight nine"
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(1, one), (2, one), (2, two), (3, two), (4, leak), (4, three), (5, None), (6, ""), (None, one), (7, long), (8, long + " x"), (9, three), (9, three)]
    df = spark.createDataFrame([(i, t, "en", len(t or ""), 7, 8) for i, t in texts], "doc_id long, text string, lang string, n_chars long, key long, text_hash long").withColumn("_gone_id", F.lit(1)).withColumn("_gone", F.lit("g")).repartition(3)
    rows = lambda d: sorted(((r.doc_id or 0, (r.text or "")[:9]) for r in d.collect()))
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near-dedup"](spark, df, str(tmp_path))
    assert near.columns == df.columns
    assert rows(near) == sorted((i or 0, (t or "")[:9]) for i, t in [(1, one), (2, two), (4, leak), (4, three), (5, None), (6, ""), (None, one), (7, long)])
    clean = stages["decontamination"](spark, df, str(tmp_path))
    assert clean.columns == df.columns and rows(clean) == sorted((i or 0, (t or "")[:9]) for i, t in texts if t != leak)
    lines = stages["line dedup"](spark, df, str(tmp_path))
    assert lines.columns == df.columns and lines.count() == len(texts) and lines.where("text IS NULL").count() == 1
    assert stages["language ID"](spark, df, str(tmp_path)).columns == df.columns
    assert stages["language ID"](spark, df.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == len(texts)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))


def test_stages_hand_python_modest_batches(spark, corpus):
    import corpus_pipeline

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    many = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    sizes = lambda df: max(r.n for r in df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect())
    spark.conf.unset(rows)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(rows, "10000")
            stage(spark, docs(spark, corpus[:20]), SF)
            assert sizes(many) == 1024
        for before, after in (("0", 1024), ("100", 100)):
            spark.conf.set(rows, before)
            corpus_pipeline.encode_tokens(spark, many, SF)
            assert sizes(many) == after
    finally:
        spark.conf.unset(rows)


def test_small_steps_and_caches_give_the_same_tokens(spark, corpus, reference_encoding):
    df = docs(spark, corpus)
    for path_rows in (df, df.limit(0)):
        want = sorted(bpe.encode_digests(path_rows).collect())
        assert sorted(bpe.encode_digests(path_rows, step=3, entries=50).collect()) == want
    t = bpe.Tokenizer(entries=100)
    for lo in range(0, 1000, 10):
        t.digests([f"word{i}" for i in range(lo, lo + 10)])
        assert len(t._young) <= 100 and len(t._old) <= 100


def test_a_tidy_task_gives_its_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    task = shared.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(task) == 2 and not calls
    assert list(task) == [4] and calls == [1]
