"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the ``K`` least distinct 64-bit hashes of a text's shingles (words are runs of anything
but space and TAB to CR, A-Z in lower case; a text with fewer words than ``size`` but some has one shingle). The least K of a union
are among the least K of its parts, so sketches of parts merge into the sketch of the whole (``merged``,
``merge_by_key``). Of two sketches, the K least of both are a sample of the union's shingles: the share of them that both
hold estimates the resemblance, and with the number of distinct shingles, which follows from where the K-th hash lies,
the containment. All three are exact for texts with fewer than K shingles; beyond, the resemblance has a standard
deviation of at most 0.045.

Sorting a long text's hashes for K of them would be wasteful, so they are cut at twice the expected K-th first; if repeats
leave fewer than K, all are sorted. Every word of every text is hashed.

The next document in descending order of ids is found without a global sort: rows are dealt to ``SLICES`` slices of the
ids at most, by approximate quantiles, and ordered within; a copy of each slice's first document goes to the slice before
it. Texts are shuffled once.

A null text is empty; an empty text, or one of blanks, has the empty sketch, which resembles only another one (by 1).
Rows that repeat a doc_id follow each other in the order of their texts' hashes; equal rows take each other as next.
Null ids come last. An only document is its own next. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.llm.url_filter import ascii_lower

K, SIZE = 128, 5
#: Rows of a slice, about, and at most so many slices (a square of a whole number).
SLICE_ROWS, SIDE = 256, 64
SLICES = SIDE * SIDE
_LOWEST, _SPAN = -9223372036854775808.0, 18446744073709551616.0


def shingle_hashes(words: Column, size: int = SIZE) -> Column:
    """A hash of each run of ``size`` words, repeats included: Spark's xxhash64 of the words one after the other."""
    n = F.size(words)
    runs = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(n - (size - 1), F.lit(0))).alias(f"w{k}") for k in range(size)])
    return F.when(n >= size, F.transform(runs, lambda r: F.xxhash64(r))).otherwise(F.filter(F.array(F.xxhash64(words)), lambda _: n > 0))


def with_sketch(df: DataFrame, text: str, name: str, size: int = SIZE, k: int = K) -> DataFrame:
    """The rows with the sketch of a text column, which is not null, in a new column."""
    words, hashes, low = f"{name}_words", f"{name}_hashes", f"{name}_low"
    n = F.size(hashes)
    below = F.lit(_LOWEST) + F.lit(2.0 * k * _SPAN) / n
    found = df.withColumn(words, F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(r"[^ \t-\r]+"), F.lit(0))).withColumn(hashes, shingle_hashes(F.col(words), size))
    short = F.when(n > 4 * k, F.array_distinct(F.filter(hashes, lambda h: h < below))).otherwise(F.array_distinct(hashes))
    enough = (n <= 4 * k) | (F.size(low) >= k)
    least = F.when(enough, F.col(low)).otherwise(F.array_distinct(hashes))
    return found.withColumn(low, short).withColumn(name, F.slice(F.sort_array(least), 1, k)).drop(words, hashes, low)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together. Shingles that lie across the parts must be in one of them."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by_key(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch) of all rows of a key together, such as the documents of a source; hashes are cut to the least k
    within slices of a key before they meet."""
    each = df.select(key, F.explode(sketch).alias("h")).distinct()
    ranked = lambda d, *by: d.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= k)
    least = ranked(ranked(each.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(32))), key, "slice").drop("r", "slice"), key)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """How many distinct shingles, about; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") - F.lit(_LOWEST)) / F.lit(_SPAN)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of both texts' distinct shingles that both have, about; 1 for two empty sketches."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's distinct shingles that b has, about; 1 if a is empty."""
    share = resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def encode(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, in the sketch's order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def decode(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9a-f]{16}"), F.lit(0)), lambda h: F.conv(h, 16, -10).cast("long"))


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the key: first of every ``SIDE``-th, then of those that follow."""
    if not bounds:
        return F.lit(0)
    of = lambda values: F.size(F.filter(F.array(*map(F.lit, values)).cast("array<bigint>"), lambda b: b <= key))
    coarse = bounds[SIDE - 1 :: SIDE]
    if not coarse:
        return F.when(key.isNull(), 0).otherwise(of(bounds))
    fine = F.array(*[F.array(*map(F.lit, bounds[i : i + SIDE - 1])).cast("array<bigint>") for i in range(0, len(bounds), SIDE)])
    step = of(coarse)
    return F.when(key.isNull(), 0).otherwise(step * SIDE + F.size(F.filter(F.coalesce(F.get(fine, step), F.array().cast("array<bigint>")), lambda b: b <= key)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document with the next one in descending order of doc_id; the
    last one takes the first."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    count = own.count()
    slices = max(1, min(SLICES, count // SLICE_ROWS))
    marks = own.agg(F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 4 * SLICES)).first()[0] if slices > 1 else []
    bounds = sorted(set(marks or []))
    placed = own.withColumn("slice", _slice_of(F.col("doc_id"), bounds))
    # A row for each slice: its first document is needed at the end of the slice above, the topmost one's in the lowest.
    order = Window.orderBy("slice")
    tops = placed.groupBy("slice").agg(F.max("doc_id").alias("top"))
    tops = tops.select("top", F.coalesce(F.lead("slice").over(order), F.min("slice").over(Window.partitionBy())).alias("above"), F.col("slice").alias("top_slice"))
    same = (placed["slice"] == tops["top_slice"]) & placed["doc_id"].eqNullSafe(tops["top"])
    place = lambda slice_, copy: F.struct(slice_.alias("slice"), F.lit(copy).alias("copy"))
    places = F.when(F.col("above").isNotNull(), F.array(place(F.col("slice"), False), place(F.col("above"), True))).otherwise(F.array(place(F.col("slice"), False)))
    dealt = placed.join(F.broadcast(tops), same, "left").select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.slice", "at.copy")
    dealt = with_sketch(dealt.repartition(F.col("slice")), "text", "sketch")
    follow = Window.partitionBy("slice").orderBy("copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return dealt.select("*", F.lead("text").over(follow).alias("next_text"), F.lead("sketch").over(follow).alias("next_sketch")).where(~F.col("copy")).drop("slice", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles and
    next_containment: each document against its edited text (its last third replaced by as much of the next one's
    beginning) and against the next document; the last two are estimates of its distinct shingles and of their share in
    the next one."""
    length = F.length("text")
    third = F.floor(length / 3).cast("int")
    pairs = with_next(docs).withColumn("n_chars", length.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), length - third), F.substring("next_text", F.lit(1), third)))
    both = with_sketch(pairs.drop("text", "next_text"), "edited", "edited_sketch")
    sketch, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encode(sketch).alias("fingerprint"), encode(edited).alias("edited_fingerprint"),
        resemblance(sketch, edited).alias("near_edited"), resemblance(sketch, following).alias("near_next"),
        distinct_count(sketch).alias("n_shingles"), containment(sketch, following).alias("next_containment"),
    )
