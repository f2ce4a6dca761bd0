"""The queries of this subpackage's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, hnsw, license_scan, mixing, pii, quality_rules, rule_ensemble, simhash, token_files, url_rules
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


#: The given rules of the URL filter.
URL_RULES = [
    url_rules.Rule("allow", "org"), url_rules.Rule("block", "example.org", "es/"), url_rules.Rule("block", "example.org", "en/1"),
    url_rules.Rule("allow", "com", "fr/"), url_rules.Rule("block", "com", "de/"),
]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # A row without an id has the empty text as id.
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = rule_ensemble.learn(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    found = rule_ensemble.scored(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.judged(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return hnsw.nearest(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scanned(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sizes_and_taken(table(spark, sf_dir, "documents"))


def url_rules_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the given rules alone decide, by operator 2."""
    return op2_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and places of the plain phrases, by operator 6."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of plain finds, by operator 9."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets, by operator 10."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Query]:
    ten = (op1_token_files, op2_url_rules, op3_quality_rules, op4_byte_bpe, op5_rule_ensemble, op6_license_scan, op7_simhash, op8_hnsw, op9_pii, op10_mixing)
    return {f.__name__: f for f in (*ten, url_rules_given, license_base, pii_base, mixing_targets)}


#: The base counts, both kinds of verdict, window by window.
QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), placed AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w
), runs AS (
  SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS run, lead(w, 7) OVER o AS last
  FROM placed WINDOW o AS (PARTITION BY rid ORDER BY i)
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS n FROM runs WHERE last IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat FROM (SELECT rid, i, unnest(range(8)) AS o FROM windows WHERE n > 1) GROUP BY rid
), lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), c AS (
  SELECT w.doc_id, w.t, w.ws, len(w.ws)::BIGINT AS n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(w.t, '\p{Lu}')) AS big, len(regexp_extract_all(w.t, '\p{Ll}')) AS small, len(list_distinct(w.ws)) AS n_distinct
  FROM w JOIN lines USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
    OR 100 * big > 70 * (big + small) OR (n_words <= 500 AND 100 * n_distinct < 22 * n_words)) AS kept
FROM c
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM r),
u AS (SELECT page_id, {_LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
FROM u
"""

LICENSE_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
placed AS (SELECT rid, w, i - 1 AS i, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w) WINDOW o AS (PARTITION BY rid ORDER BY i)),
hit AS (SELECT rid, i, CASE WHEN w = 'mit' AND w2 = 'license' THEN 'mit' WHEN w = 'apache' AND w2 = 'license' THEN 'apache' WHEN w = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' END AS label FROM placed),
g AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit WHERE label IS NOT NULL GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (rid)
"""

PII_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT rid, regexp_replace(unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')), '[^0-9]', '', 'g') AS x FROM d),
luhn AS (SELECT rid, count(*) AS n FROM c WHERE length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k:
  CASE WHEN k % 2 = 1 THEN CAST(substr(x, length(x) - k + 1, 1) AS INT) WHEN CAST(substr(x, length(x) - k + 1, 1) AS INT) > 4 THEN 2 * CAST(substr(x, length(x) - k + 1, 1) AS INT) - 9
  ELSE 2 * CAST(substr(x, length(x) - k + 1, 1) AS INT) END)) % 10 = 0 GROUP BY rid)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0))::BIGINT AS n_ip,
  coalesce(luhn.n, 0)::BIGINT AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM d LEFT JOIN luhn USING (rid)
"""

#: Sharing by weight with caps, by the level at which the sources under their caps get the same for their weight.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight
  FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN remaining / weight * w <= cap THEN remaining / weight END AS free FROM o),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(free, cap / w) FROM l WHERE free IS NOT NULL) * w, cap)) AS target FROM l)
SELECT doc_id, size, source_size, round(target::DOUBLE, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": QUALITY_SQL, "url_rules_given": URL_SQL, "license_base": LICENSE_SQL, "pii_base": PII_SQL, "mixing_targets": MIXING_SQL}
