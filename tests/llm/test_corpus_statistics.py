"""Source divergence, fingerprints and spelling variants against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from terradelta.llm import divergence, sketches, variants

CLASH = ("term", "n", "key", "slice", "sketch", "word", "rows", "value")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


# --- 11: divergence ---------------------------------------------------------------------------------------------------
def brute_audit(rows):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(lang or "", source or "", collections.Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold(text or "")))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in collections.Counter(t for d in own for t in d[2]).items() if n >= 3]
        group = {s: collections.Counter() for _, s, _ in own}
        for _, s, c in own:
            group[s].update({t: c[t] for t in kept if c[t]})
        whole = sum(group.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        ps, q = {s: p(c) for s, c in group.items()}, p(whole)
        for s in group:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in group if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if group[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, divergence.TERM_RANKS)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "漢字", "ABC", "abc"]
    rows = [(k, " ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randint(0, 60))), rng.choice(["x", "x", "y", None]), "hot" if k % 3 else rng.choice(["a", "b", None, "é"])) for k in range(150)]
    return [*rows, (None, None, "z", "only"), (1, "", "z", "two"), (1, "one two", "q", "s"), (1, "one two", "q", "s"), (5, "\x00", None, None), (6, "long " * 30000 + "ABC", "x", "hot")]


@pytest.mark.parametrize("nodes", [200_000, 5])
def test_divergence_is_exact(spark, sources, monkeypatch, nodes):
    for name, value in (("NODES", nodes), ("HELD", 40 if nodes == 5 else 10**6), ("BLOCK", 2 if nodes == 5 else 1024), ("TERM_RANKS", 20)):
        monkeypatch.setattr(divergence, name, value)
    got = [tuple(r) for r in divergence.audit(table(spark, sources).repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute_audit(sources)
    assert len(got) == len(want) and set(got) == want
    assert divergence.audit(table(spark, sources).limit(0)).count() == 0


def test_a_tree_shares_paths_and_corrects_each_pair_of_entries():
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(5), rng.randint(1, 5))), rng.randint(1, 4)) for _ in range(40)]
    rows = [([(s, 10 + rng.randint(1, 3) * (s + 1), s + 1) for s in own], n) for own, n in rows]
    tree, want = divergence.TermTree(), collections.Counter()
    for entries, n in rows:
        tree.insert(entries, n)
        for (a, pa_, fa), (b, pb, fb) in itertools.permutations(entries, 2):
            f = lambda p, q: (p - q) ** 2 // q
            want[a, b] += n * (f(pa_, pb) - f(pa_, fb) - f(fa, pb) + f(fa, fb))
    a, b, value = tree.corrections()
    assert {(x, y): v for x, y, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True)} == dict(want)
    assert len(tree.parent) - 1 < sum(len(e) for e, _ in rows)


# --- 12: fingerprints -------------------------------------------------------------------------------------------------
def brute_sketch(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = set()
    for run in [w[i : i + size] for i in range(len(w) - size + 1)] or ([w] if w else []):
        h = 42
        for x in run:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_and_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(sketches, "SLICE_ROWS", 7)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeÉ漢🙂") for _ in range(rng.randint(1, 5))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 6, 40, 90, 700]))) for _ in range(90)] + [None, "", " \n", "one", texts_long := " ".join(rng.choices(words, k=30000))]
    rows = [(rng.randint(0, 10**6) * 2 - 10**6 + 1, t, "en", "s") for t in texts]
    rows[5] = (None, *rows[5][1:])
    got = {r["doc_id"]: r for r in sketches.fingerprints(table(spark, rows).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0] if r[0] is not None else 10**9)
    for (doc, text, *_), (_, following, *_) in zip(order, [*order[1:], order[0]], strict=True):
        text, following, r = text or "", following or "", got[doc]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, changed, other = map(brute_sketch, (text, edited, following))
        hexed = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(s)[: sketches.K])
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(changed))
        assert abs(r["near_edited"] - near(own, changed)) < 0.2 and abs(r["near_next"] - near(own, other)) < 0.1
        if len(own | changed) <= sketches.K:
            assert r["near_edited"] == near(own, changed)
        assert r["n_shingles"] == len(own) if len(own) < sketches.K else abs(r["n_shingles"] / len(own) - 1) < 0.4
    assert len(got) == len(rows) and texts_long
    one = sketches.fingerprints(table(spark, [(3, "a b c d e f", "x", "y")])).first()
    assert one["near_next"] == 1.0 and sketches.fingerprints(table(spark, rows).limit(0)).count() == 0
    copies = sketches.fingerprints(table(spark, [(7, "same text", "x", "y")] * 40 + [(8, "a", "x", "y")]))
    assert sorted(r["near_next"] for r in copies.collect()).count(1.0) == 39


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    parts = [(k % 3, " ".join(rng.choices(words, k=300))) for k in range(12)]
    df = sketches.with_sketch(spark.createDataFrame(parts, "k long, text string"), "text", "s")
    whole = {k: set().union(*(brute_sketch(t) for i, t in parts if i == k)) for k in range(3)}
    got = {r["k"]: r["s"] for r in sketches.merge_by_key(df, "k", "s").collect()}
    assert got == {k: sorted(s)[: sketches.K] for k, s in whole.items()}
    two = df.limit(2).agg(F.collect_list("s").alias("a")).select(F.col("a")[0].alias("x"), F.col("a")[1].alias("y"))
    r = two.select(sketches.merged(F.col("x"), F.col("y")).alias("m"), "x", "y", sketches.decode(sketches.encode(F.col("x"))).alias("back"), sketches.containment(F.col("x"), sketches.merged(F.col("x"), F.col("y"))).alias("inside")).first()
    assert r["m"] == sorted({*r["x"], *r["y"]})[: sketches.K] and r["back"] == r["x"] and r["inside"] > 0.7


def test_the_fingerprint_plan_has_no_python(spark):
    plan = sketches.fingerprints(table(spark, [(1, "a", "x", "y")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 13: variants -----------------------------------------------------------------------------------------------------
def brute_variants(rows):
    counts = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    near_of = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(own, key=lambda x: (-counts[x], x)) for w, own in near_of.items() if own}
    form = {w: x for w, x in best.items() if counts[x] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near_of[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("shares, block", [(20_000, 256), (40, 2)])
def test_variants_are_all_found(spark, monkeypatch, shares, block):
    monkeypatch.setattr(variants, "SHARES", shares)
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "HELD", 50)
    rng = random.Random(shares)
    words = []
    for _ in range(12):
        base = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 19)))
        for n in (130, 25, 5):
            words += [base] * n
            at = rng.randrange(len(base))
            base = rng.choice([base[:at] + base[at + 1 :], base[:at] + rng.choice("abcñ") + base[at:], base[:at] + rng.choice("abcñ") + base[at + 1 :]])
    words += ["ÄBCDEF", "äbcdef", "Äbcdef"] * 4 + ["x" * 4000] * 6 + ["x" * 4001] * 40 + ["short"] * 9 + ["rareword"] * 4
    rng.shuffle(words)
    rows = [(k, " ".join(words[k :: 160]).replace(" ", rng.choice([" ", "-", "7"])), "en", "s") for k in range(160)] + [(None, "äbcdef", "e", "s"), (3, None, "e", "s"), (4, "", "e", "s")]
    got = [tuple(r) for r in variants.group_variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(f and f != r for _, f, r, *_ in got)  # a chain of two
    assert variants.group_variants(table(spark, rows).limit(0)).count() == 0


def test_entries_survive_any_edit():
    rng = random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(6, 14)))
        at = rng.randrange(len(word) + 1)
        other = rng.choice([word[:at] + rng.choice("abc") + word[at:], word[:at] + rng.choice("abc") + word[at + 1 :]])
        if not one_edit(word, other):
            continue
        frequent = {g: rng.randint(1, 9) for g in ("ab", "aa", "ba", "aab", "aba", "abab", "bb") if rng.random() < 0.7}
        short = min(len(word), len(other))
        sides = [{s for k, g in variants.entries(w, short // 2, frequent) for s in ((0, w[: k + len(g)]), (1, w[k:]))} for w in (word, other)]
        assert sides[0] & sides[1], (word, other, frequent)
