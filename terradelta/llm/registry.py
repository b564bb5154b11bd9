"""The llm queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm import audio, bpe, decontaminate, divergence, language_id, line_dedup, minhash, quality, sketches, token_counts, url_filter, variants, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by two co-trained views."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after two edits to it."""
    docs = _table(spark, sf_dir, "documents")
    edits = token_counts.sample_edits(F.col("text"), F.col("source"))
    return token_counts.edited_counts(docs.select("doc_id", "text", edits.alias("edits")))


def op9_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as 8-bit sound, read back, with log-mel and segment features."""
    return audio.text_media(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text and the decoded bytes, as digests."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items they contain: 80 percent of the item's 5-word shingles or more."""
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that at least 3 documents hold stay only in the largest doc_id."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), spark.sql(url_filter.RULES))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are similar by 85 percent or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85).drop("text_hash")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the other sources of its language, and the terms by which it exceeds the language."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketch of every document and of its edited text, with their likeness."""
    return sketches.fingerprints(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the near word it is a variant of, and the end of that chain."""
    return variants.group_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_audio_media": op9_audio_media,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_fingerprints": op12_fingerprints,
    "op13_spelling_variants": op13_spelling_variants,
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _shingle_sql(table: str, key: str, size: int, name: str) -> str:
    """CTEs: ``name`` has the distinct shingles (key, sh) of every row of a table."""
    return f"""
{name}_w AS (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^ \\t-\\r]+') AS w FROM {table}),
{name}_i AS (SELECT {key}, w, unnest(range(greatest(len(w) - {size} + 1, least(len(w), 1)))) AS i FROM {name}_w),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i + 1:i + {size}], ' ') AS sh FROM {name}_i)"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH {_shingle_sql("benchmark", "item_id", 5, "b")},{_shingle_sql("documents", "doc_id", 5, "d")},
n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_common FROM d JOIN b USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_common, n_item, n_common / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_common >= 0.8 * n_item""",
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)""",
    "op6_minhash_dedup": f"""
WITH RECURSIVE {_shingle_sql("documents", "doc_id", 3, "d")},
n AS (SELECT doc_id, count(sh)::BIGINT AS n FROM (SELECT doc_id FROM documents) LEFT JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS t FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
SELECT n.doc_id, n.n AS n_shingles, min(r.t) AS component_id, min(r.t) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n""",
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANK}), {_LOWER}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.keeper IS NULL OR r.keeper = k.doc_id AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op11_source_divergence": f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d WHERE len(w) > 0),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, source, t.term, count(*)::HUGEINT AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term AS term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
      FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200""",
    "op3_url_filter": f"""
WITH r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, p, v)),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM pages),
m AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
}
