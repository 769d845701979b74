"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, media, mixing, near_duplicates, packing, pii, quality_classifier, quality_rules, token_counts, url_filters


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.verdicts(_docs(spark, sf_dir).select("doc_id", "text", "lang"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_docs(spark, sf_dir))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_docs(spark, sf_dir), near_duplicates.Join(words=4, num=85, den=100))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_docs(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.drop("text")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures have no fetch time of their own: page n was fetched n hours into 2024, modulo a year."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id % 8760 AS INT))")
    judged = url_filters.judge(pages.select("page_id", "url", at.alias("fetched_at")), url_filters.production_list(spark))
    return judged.select("page_id", "url", "url_host", "url_entries", "url_rule", "url_action", "url_kept")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_docs(spark, sf_dir)).drop("error")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(_docs(spark, sf_dir).select("doc_id", "text")))


ORACLES: dict[str, str] = {}

def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, quality_classifier.train(docs, labels))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_mix_sources": op4_mix_sources,
    "op5_url_filters": op5_url_filters,
    "op6_media_columns": op6_media_columns,
    "op7_pii": op7_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
}


def _rule_sql(rule: quality_rules.Rule) -> str:
    top, _, bottom = rule.measure.partition(" / ")
    value = f"CASE WHEN {bottom} > 0 THEN {top} / CAST({bottom} AS DOUBLE) ELSE 0 END" if bottom else top
    tests = ([f"({value}) < {rule.low}"] if rule.low is not None else []) + ([f"({value}) > {rule.high}"] if rule.high is not None else [])
    among = ", ".join(f"'{x}'" for x in rule.languages)
    return f"({' OR '.join(tests)})" + (f" AND coalesce(lang IN ({among}), false)" if among else "")


_STOP = ", ".join(f"'{f}'" for f in sorted({f for w in quality_rules.STOP_WORDS for f in (w, w.capitalize())}))
OP1_SQL = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]\s'))) AS n_bullets,
  len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipses, len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop_words,
  len(regexp_extract_all(t, '\p{{L}}')) AS n_letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaim
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT ({" OR ".join(map(_rule_sql, quality_rules.RULES))}) AS kept FROM m
"""
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.least, d.doc_id) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) c ON c.a = d.doc_id
"""
_EVENTS = ", ".join(f"('{k}', {'NULL' if a is None else repr(a)}, {d})" for k, a, d in url_filters.LIST_EVENTS)
OP5_SQL = rf"""
WITH log(key, action, day) AS (SELECT lower(split_part(key, '/', 1)) || substr(key, length(split_part(key, '/', 1)) + 1), action, day FROM (VALUES {_EVENTS}) t(key, action, day)),
ev AS (SELECT key, action, TIMESTAMP '2024-01-01' + to_days(day) AS since, lead(TIMESTAMP '2024-01-01' + to_days(day)) OVER (PARTITION BY key ORDER BY day) AS until FROM log),
c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(page_id % 8760) AS fetched,
  regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.+$', '') AS host,
  regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/+$', '') AS path FROM pages),
k AS (SELECT DISTINCT page_id, fetched, k FROM (SELECT page_id, fetched, array_to_string(parts[i:], '.') AS k FROM (SELECT page_id, fetched, string_split(host, '.') AS parts, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')
  UNION ALL SELECT page_id, fetched, host || path FROM c WHERE host <> '')),
hit AS (SELECT page_id, key, action, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key DESC) AS r
  FROM k JOIN ev ON key = k AND fetched >= since AND (until IS NULL OR fetched < until) WHERE action IS NOT NULL)
SELECT c.page_id, url, host AS url_host, CAST(coalesce(n, 0) AS BIGINT) AS url_entries, key AS url_rule, coalesce(action, 'keep') AS url_action, coalesce(action, 'keep') <> 'block' AS url_kept
FROM c LEFT JOIN hit ON hit.page_id = c.page_id AND r = 1
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op5_url_filters": OP5_SQL}
