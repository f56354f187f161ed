"""The production queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm.decontam import contaminated
from vectorloom.llm.fingerprint import neighbour_fingerprints
from vectorloom.llm.html_extract import extract_pages
from vectorloom.llm.jaccard_join import jaccard_components
from vectorloom.llm.mixing import mix_sources
from vectorloom.llm.ngram_lm import lm_scores
from vectorloom.llm.quality import quality_scores
from vectorloom.llm.secrets import scan_secrets
from vectorloom.llm.suffix_dedup import remove_repeats
from vectorloom.llm.url_filter import filter_urls


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at Jaccard 0.9 over 3-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, threshold=90).drop("copies")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents contain; clean documents give no rows."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep when 100-byte strings that start earlier are cut out."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by four rules and a list of blocked hosts."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base kinds and random tokens."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside the held-out fold."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_join": op1_ngram_join, "op2_fingerprints": op2_fingerprints, "op3_lm_score": op3_lm_score, "op4_decontaminate": op4_decontaminate, "op5_suffix_dedup": op5_suffix_dedup, "op6_url_filter": op6_url_filter, "op7_secret_scan": op7_secret_scan, "op8_source_mix": op8_source_mix, "op9_html_text": op9_html_text, "op10_quality": op10_quality}


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
found AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, f.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN found f ON f.id = d.doc_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth
    FROM (SELECT doc_id, u.p, substr(h, 2 * u.p + 1, 200) AS s FROM d, LATERAL (SELECT unnest(range(n - 99)) AS p) u))
  WHERE nth > 1),
runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM starts)),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
cut AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept, max(e) AS e, sum(e - s) AS removed, count(*) AS spans
  FROM pieces JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c USING (doc_id)
"""

OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, rh, rp, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
listed(key) AS (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT arg_max(action, length(rule)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS action,
    (SELECT max(key) FROM listed WHERE host = key OR ends_with(host, '.' || key)) AS listed
  FROM parts)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM judged
"""


OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighted AS (SELECT *, (nth % 3 + 1)::BIGINT AS w, 3 * s AS most FROM by_source),
-- rounds: what is above its limit stops there, the excess is reshared by weight
rounds(full_ones, lft, open, again) AS (
  SELECT []::BIGINT[], (SELECT sum(s)::BIGINT FROM weighted), (SELECT sum(w)::BIGINT FROM weighted), true
  UNION ALL
  SELECT list_concat(full_ones, n.f),
         (lft - coalesce((SELECT sum(most) FROM weighted WHERE list_contains(n.f, nth)), 0))::BIGINT,
         (open - coalesce((SELECT sum(w) FROM weighted WHERE list_contains(n.f, nth)), 0))::BIGINT,
         len(n.f) > 0
  FROM rounds, LATERAL (SELECT coalesce(list(nth), []) AS f FROM weighted
                        WHERE NOT list_contains(full_ones, nth) AND lft * w >= most * open) n
  WHERE again),
final AS (SELECT * FROM rounds WHERE NOT again),
targets AS (
  SELECT source, s AS source_size,
         CASE WHEN list_contains(full_ones, nth) THEN most::DOUBLE ELSE (lft * w)::DOUBLE / open::DOUBLE END AS target
  FROM weighted, final),
placed AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
                         ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
stamped AS (
  SELECT p.doc_id, p.source, p.size, p.e, (source_size * k + e)::DOUBLE / target AS time
  FROM placed p, range(3) r(k) WHERE size > 0 AND target > 0),
queue AS (SELECT time, sum(sum(size)) OVER (ORDER BY time) AS upto FROM stamped GROUP BY time),
stop AS (SELECT max(time) AS last FROM queue WHERE upto <= (SELECT sum(size) FROM sized))
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size > 0 AND target > 0 THEN size * (
         ((e::DOUBLE / target <= last)::BIGINT) + (((source_size + e)::DOUBLE / target <= last)::BIGINT)
         + (((2 * source_size + e)::DOUBLE / target <= last)::BIGINT)) ELSE 0 END::BIGINT AS taken
FROM placed, stop
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op6_url_filter": OP6_SQL, "op8_source_mix": OP8_SQL}
