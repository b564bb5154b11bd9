"""URL rules by a sort-merge range join over reversed-host keys, with DataFrame operations only.

A rule (host, path, verdict) fits a URL whose host is the rule's or below it and whose path starts with the rule's. With
the host's labels reversed, a host and a path make the canonical key ``com,example,/en/...``; under a given rule host,
the URLs that a rule fits are those whose key starts with the rule's key, which is one interval of the sorted keys:
from the key itself up to the key followed by byte 255, which UTF-8 never holds. As a rule also fits subdomains, a URL
has one probe key for each suffix of its host that has as many labels as some rule's host; so a host of thousands of
labels costs no more than its rules do.

Intervals of prefixes are nested or apart. The sweep over the sorted keys meets an event where a rule opens, which makes
it the innermost active rule, and one where it closes, which makes its enclosing rule active again: the parent that each
closing event carries is what the stack would uncover. The innermost rule of a probe is thus the last event before it.
Probes and events are range-partitioned together, ties between equal URLs included, so a hot host or a hot URL spreads
over partitions; each partition starts with the last event of those before it. Of a page's probes, the longest rule wins
(then the longer host).

A null URL, or one without ``://``, has an empty host and path. An empty host or path fits no rule unless the rule's
path is empty. Pages that no rule fits get ``default``. Of rules with equal host and path one counts: block before
allow. Rules with a null host are ignored; a null path is empty. Rows that repeat a page_id are judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terradelta.llm.shared import cut

#: The query's rules (fixed values of its contract).
RULES = """SELECT * FROM VALUES
  ('com', '/', 'allow'),
  ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'),
  ('net', '/fr/', 'block') AS rules(host, path, verdict)"""
DEFAULT = "allow"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels and the path, as bytes; a comma ends each label and sorts apart from the path's slash."""
    return F.concat(F.array_join(labels, ",").cast("binary"), F.lit(",").cast("binary"), path.cast("binary"))


def _events(rules: DataFrame) -> DataFrame:
    """Opening and closing events, each with the rule that is active from there on (null: none)."""
    own = (
        rules.where(F.col("host").isNotNull())
        .select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("low", _key(F.reverse(F.split("r_host", r"\.")), F.col("r_path")))
        .withColumn("active", F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"), F.concat("r_host", "r_path").alias("rule"), "verdict"))
    )
    # A rule's parent has the same host and the longest path that is a proper prefix: an equi join on prefixes.
    prefixes = own.where(F.length("r_path") > 0).select("r_host", "r_path", F.explode(F.sequence(F.lit(0), F.length("r_path") - 1)).alias("n"))
    parents = (
        prefixes.withColumn("prefix", F.expr("substring(r_path, 1, n)"))
        .join(own.select(F.col("r_host").alias("p_host"), F.col("r_path").alias("p_path"), F.col("active").alias("p_active")), (F.col("r_host") == F.col("p_host")) & (F.col("prefix") == F.col("p_path")))
        .groupBy("r_host", "r_path")
        .agg(F.max_by("p_active", "n").alias("parent"))
    )
    with_parent = own.join(parents, ["r_host", "r_path"], "left")
    # At equal bytes closings come first, inner rules before outer ones; openings outer first; probes last.
    opening = with_parent.select(F.col("low").alias("key"), F.lit(1).alias("kind"), F.col("active.size").alias("rank"), F.struct("active").alias("event"))
    closing = with_parent.select(F.concat("low", F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), (-F.col("active.size")).alias("rank"), F.struct(F.col("parent").alias("active")).alias("event"))
    return opening.unionByName(closing)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    # The label counts of the rules' hosts, a number each: other suffixes fit no rule.
    counts = sorted(r[0] for r in rules.where(F.col("host").isNotNull()).select(F.size(F.split("host", r"\."))).distinct().collect())
    lengths = F.filter(F.array(*[F.lit(n) for n in counts]).cast("array<int>"), lambda n: n <= F.size("labels"))
    # Rows may repeat; a probe carries its page's columns, and equal pages are judged once and counted.
    counted = seen.groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    probes = (
        counted.withColumn("labels", labels)
        .withColumn("n", F.explode(F.when(F.size(lengths) > 0, lengths).otherwise(F.array(F.size("labels")))))
        .select(_key(F.slice("labels", F.lit(1), F.col("n")), F.col("path")).alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("rank"), F.lit(None).cast("struct<active:struct<size:int,host_size:int,rule:string,verdict:string>>").alias("event"), "page_id", "host", "path", "copies")
    )
    both = probes.unionByName(_events(rules), allowMissingColumns=True)
    # The page_id splits equal keys: a URL that a third of all pages share still spreads.
    dealt = cut(both.repartitionByRange("key", "kind", "rank", "page_id").withColumn("part", F.spark_partition_id()))
    order = [F.col("key"), F.col("kind"), F.col("rank")]
    last = dealt.where("kind < 2").groupBy("part").agg(F.max_by("event", F.struct("key", "kind", "rank")).alias("event"))
    parts = dealt.select("part").distinct().join(last, "part", "left")  # a row for each partition, not for data
    before = parts.select("part", F.last("event", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = (
        dealt.withColumn("latest", F.last("event", ignorenulls=True).over(sweep))
        .where("kind = 2")
        .join(F.broadcast(before), "part")
        .withColumn("found", F.coalesce("latest", "carried")["active"])
    )
    best = active.groupBy("page_id", "host", "path", "copies").agg(F.max("found").alias("found"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("page_id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )
