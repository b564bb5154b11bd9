"""How the sources of a language differ in their terms, exactly, by a frequent-pattern tree of term rows.

A term's row lists its nonzero counts by source, sources with many terms first. For two sources A and B the divergence is
a sum over all kept terms of a function of both probabilities. Most counts are zero, so the sum starts from what it would
be if all were (V terms at both sources' floors), adds for each source the terms that it has, as if the other one had
none of them, and then corrects the terms that both have. The last part needs every pair of entries within a row: rows
are inserted with their multiplicities into a tree, in which rows with a common beginning share a path, and each
combination of a node and an ancestor gives its correction once, times the node's multiplicity. Corrections add up, so
tasks build trees of any share of the rows; rows are dealt by range, which keeps common beginnings together, and a tree
that holds ``NODES`` nodes is summed and begun anew. So neither a frequent beginning nor a large vocabulary fills a task.

Terms are counted per task before the shuffle, with the number of documents that hold them. All sums are of integers:
values stay below 2**62 while a language keeps fewer than 10**9 terms, and counts are multiplied as decimals.

A null text, language or source is ''. Every row of the table is a document, also rows that repeat a doc_id; doc_id and
other columns are not read, whatever their names. A language without a kept term has pairs of value 0 and no terms. An
empty table gives no rows. Texts are read whole. Ties rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.llm.shared import cut, salted_join

#: A term is a run of these bytes of UTF-8: letters A-Z, a-z and all of what lies beyond ASCII.
TERM = b"[^\x00-\x40\x5b-\x60\x7b-\x7f]+"
#: Terms of fewer documents of a language are left out.
LEAST_DOCS = 3
#: The scale of probabilities.
SCALE = 1_000_000_000
#: Ranks of the ``term`` part.
TERM_RANKS = 200
#: A task's tree and its counts are summed and begun anew at about so many nodes or terms.
NODES, HELD = 200_000, 1_200_000
#: Sources, or distinct counts of one source, in one row of the single sums.
BLOCK = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, by (lang, term) and perhaps in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, holders) in counts.items():
                named = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                columns = [pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([holders[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([*named, *columns], ["lang", "source", "term", "n", "docs"])
            counts.clear()

        for b in batches:
            for text, lang, source in zip(*(b.column(i) for i in range(3)), strict=True):
                n, holders = counts.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
                terms = find(bytes(text.as_buffer()).translate(_LOWER)) if text.is_valid else []
                held -= len(n)
                n.update(terms)
                holders.update(set(terms))
                held += len(n)
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    found = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # one shuffle for both sums: a term's rows are few, at most one for each source and task
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """p of a count, from the columns of the counts' sum and of the number of kept terms."""
    return F.expr(f"1 + (cast({n} AS decimal(28, 0)) + 1) * {SCALE} div cast({total} + {terms} AS decimal(28, 0))")


def gap(p: str, q: str) -> str:
    """floor((p - q)**2 / q), as SQL over two columns."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


class TermTree:
    """A tree of term rows: each path from the root is a beginning of rows, each node counts the rows through it."""

    def __init__(self) -> None:
        self.child: dict[tuple[int, int, int], int] = {}
        self.parent, self.source, self.p, self.floor, self.rows = ([-1], [-1], [0], [0], [0])

    def insert(self, entries: list[tuple[int, int, int]], rows: int) -> None:
        """Adds ``rows`` rows of these (source, p, floor), where p is the probability of the count and floor that of none."""
        at = 0
        for source, p, floor in entries:
            key = at, source, p
            at = self.child.get(key, 0)
            if not at:
                at = self.child[key] = len(self.parent)
                self.parent.append(key[0])
                self.source.append(source)
                self.p.append(p)
                self.floor.append(floor)
                self.rows.append(0)
            self.rows[at] += rows

    def corrections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, item, value): what each pair of sources adds for the terms that both have, all nodes and ancestors."""
        parent, source, p, floor, rows = (np.array(x, np.int64) for x in (self.parent, self.source, self.p, self.floor, self.rows))
        width = int(source.max(initial=0)) + 1
        sums: dict[int, int] = {}
        node = np.arange(1, len(parent))
        above = parent[node]
        while True:
            inside = above > 0
            node, above = node[inside], above[inside]
            if not len(node):
                break
            for x, y in ((node, above), (above, node)):
                f = lambda a, b: (a - b) * (a - b) // b
                value = f(p[x], p[y]) - f(p[x], floor[y]) - f(floor[x], p[y]) + f(floor[x], floor[y])
                pairs, back = np.unique(source[x] * width + source[y], return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, back, value * rows[node])
                for k, v in zip(pairs.tolist(), total.tolist(), strict=True):
                    sums[k] = sums.get(k, 0) + v
            above = parent[above]
        keys = np.array(list(sums), np.int64)
        return keys // width, keys % width, np.array(list(sums.values()), np.int64)


def _corrections(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of (lang, row, rows): the summed corrections of each pair of sources, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, code = TermTree(), {}

        def out() -> pa.RecordBatch:
            names = list(code)
            a, b, value = tree.corrections()
            langs = [names[k][0] for k in a.tolist()]
            one, two = ([names[k][1] for k in x.tolist()] for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])

        for batch in batches:
            row = batch.column(1)
            flat, at = row.flatten(), (row.offsets.to_numpy() - row.offsets[0].as_py()).tolist()
            source, p, floor = (flat.field(flat.type.get_field_index(c)).to_pylist() for c in ("source", "p", "floor"))
            for k, (lang, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lo, hi = at[k], at[k + 1]
                ids = [code.setdefault((lang, s), len(code)) for s in source[lo:hi]]
                tree.insert(list(zip(ids, p[lo:hi], floor[lo:hi], strict=True)), n)
                if len(tree.parent) > NODES:
                    yield out()
                    tree, code = TermTree(), {}
        yield out()

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source is from each other source of its language (part ``pair``,
    all of them) and by which terms it exceeds its language (part ``term``, the first ``TERM_RANKS``)."""
    by_term = term_counts(docs).groupBy("lang", "term")
    kept = by_term.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row")).where(F.col("docs") >= LEAST_DOCS)
    kept = cut(kept.select("lang", "term", "total", "row"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    entries = kept.select("lang", "term", "total", F.inline("row"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("source_total"), F.count("*").alias("source_terms"))
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    amount = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = groups.select("lang", "source", *[amount(F.col(c)).alias(c) for c in ("source_total", "source_terms", "terms", "lang_total")])
    some = F.col("terms") > 0
    groups = cut(groups.withColumn("floor", F.when(some, probability("0", "source_total", "terms"))).withColumn("key", F.struct("lang", "source")))
    sized = salted_join(entries.withColumn("key", F.struct("lang", "source")).drop("lang", "source"), groups, "key", "term", groups.select("key", F.col("source_terms").alias("n")))
    sized = cut(sized.withColumn("p", probability("n", "source_total", "terms")))
    return _pairs(sized, groups).unionByName(_terms(sized))


def _terms(sized: DataFrame) -> DataFrame:
    """The ``term`` part; a source's terms are ranked within slices first, so that a large source is no single task."""
    q = probability("total", "lang_total", "terms")
    above = sized.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    sliced = above.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(32)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*order))).where(F.col("rank") <= TERM_RANKS)
    ranked = first.drop("rank", "slice").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= TERM_RANKS)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _singles(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sums of each pair of sources without the terms that both have.

    A source's distinct probabilities, with the number of its terms that have them, come in blocks of about ``BLOCK``, and
    so do the sources that each block meets.
    """
    spread = sized.groupBy("lang", "source", "p").agg(F.count("*").alias("rows"))
    block = F.pmod(F.xxhash64("p"), F.ceil(F.sqrt("source_total") / BLOCK) + 1)
    blocks = spread.join(groups, ["lang", "source"]).withColumn("block", block).groupBy("lang", "source", "block", "floor").agg(F.collect_list(F.struct("p", "rows")).alias("own"))
    base = groups.select("lang", "source", F.lit(-1).cast("long").alias("block"), "floor", F.array(F.struct(F.lit(None).cast("long").alias("p"), F.col("terms").alias("rows"))).alias("own"))
    places = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("places"))
    place = F.pmod(F.xxhash64("source"), F.col("places"))
    others = groups.join(places, "lang").withColumn("to", F.struct("lang", place.alias("place"))).groupBy("to").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("floor").alias("q"))).alias("others"))
    dealt = base.unionByName(blocks).join(places, "lang").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)))
    # a row has up to BLOCK sources on either side, so even a language of all rows is few rows here
    met = dealt.withColumn("to", F.struct("lang", "place")).drop("place", "places").join(others, "to")
    each = met.select("lang", "source", "block", "floor", "own", F.inline("others")).where("item <> source")
    total = lambda term: F.expr(f"aggregate(own, 0L, (s, x) -> s + x.rows * ({term}))")
    none = gap("floor", "q")
    ahead = F.when(F.col("block") < 0, total(none)).otherwise(total(f"{gap('x.p', 'q')} - {none}"))
    behind = F.when(F.col("block") >= 0, total(f"{gap('q', 'x.p')} - {gap('q', 'floor')}"))
    both = each.select("lang", F.explode(F.array(F.struct("source", "item", ahead.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), behind.alias("value")))).alias("e"))
    return both.select("lang", "e.source", "e.item", F.coalesce("e.value", F.lit(0).cast("long")).alias("value"))


def _pairs(sized: DataFrame, groups: DataFrame) -> DataFrame:
    """The ``pair`` part."""
    entry = F.struct((-F.col("source_terms")).alias("order"), "source", "p", "floor")
    rows = sized.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("row")).where(F.size("row") > 1)
    rows = cut(rows.groupBy("lang", "row").agg(F.count("*").alias("rows")))
    shared = _corrections(rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row").select("lang", "row", "rows"))
    parts = _singles(sized, groups).unionByName(shared)
    value = F.sum(F.col("value").cast("decimal(38,0)")).cast("long")
    summed = parts.groupBy("lang", "source", "item").agg(value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
