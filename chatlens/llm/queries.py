"""Registered queries of this subpackage: each applies one operator with its
production parameters to its whole table. ``SQL`` has the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import (
    decontaminate, language_id, license_scan, mixing, ngram_join, packing, pii, quality_rules, runs,
    sharding, spelling, token_counts, url_filter)
from chatlens.llm.common import local_table, prepare, table

# Fixed values: (host, path, action).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))
TOKEN_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
PACK_FILE = "word_bpe_49k.json"
PACK_END = 1


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rules = local_table(spark, list(URL_RULES), "host string,path string,action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, spare_col="text").select("doc_id", "slot", "shard")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path(TOKEN_FILE), TOKEN_LIMIT)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return (ngram_join.join(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                      short_span=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_FILE), PACK_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return runs.report(runs.detect(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_url_filter, op3_sharding, op4_token_counts, op5_source_mixing, op6_language_id,
    op7_ngram_jaccard, op8_license_scan, op9_decontamination, op10_quality_rules,
    op11_spelling_variants, op12_packing, op13_periodic_runs)}


def _values(rows) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


SQL_URL = f"""
WITH rules(r_host, r_path, action) AS (VALUES {_values(URL_RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
cut AS (SELECT rid, page_id, CASE WHEN contains(url, '://')
                                  THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT rid, page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT rid, r_host || r_path AS rule, action,
               row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC, length(r_host) DESC,
                                  action DESC) AS place
        FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (rid)"""

_SLOT = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS BIGINT)"


def _sql_sharding() -> str:
    held = ", ".join(map(str, sharding.fill_table()))
    return f"""
SELECT doc_id, slot, 'shard-' || lpad(CAST(([{held}])[slot + 1] AS VARCHAR), 2, '0') AS shard
FROM (SELECT doc_id, {_SLOT} % {sharding.SLOTS} AS slot FROM documents)"""


# the schedule of a period is played through slot by slot here
SQL_MIXING = f"""
WITH RECURSIVE given(class, weight, place) AS (VALUES {_values(
    (s, w, k) for k, (s, w) in enumerate(mixing.WEIGHTS.items()))}),
d AS (SELECT doc_id, source, CASE WHEN source IN (SELECT class FROM given WHERE class <> '{mixing.OTHER}')
                                  THEN source ELSE '{mixing.OTHER}' END AS class,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))) AS key
      FROM documents),
numbered AS (SELECT doc_id, source, class, row_number() OVER (PARTITION BY class ORDER BY key) - 1 AS row FROM d),
have AS (SELECT class, count(*) AS n FROM d GROUP BY class),
w AS (SELECT class, weight, n, row_number() OVER (ORDER BY place) AS k FROM given JOIN have USING (class)),
lists AS (SELECT list(weight ORDER BY k) AS ws, CAST(sum(weight) AS BIGINT) AS total FROM w),
play(slot, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT slot + 1,
         list_transform(range(1, len(ws) + 1), lambda i: done[i] + CASE WHEN i = choice THEN 1 ELSE 0 END), choice
  FROM (SELECT slot, done, ws, total,
               list_min(list_transform(range(1, len(ws) + 1), lambda i:
                 CASE WHEN done[i] < ws[i] AND (done[i] * total) // ws[i] <= slot + 1
                      THEN (((done[i] + 1) * total + ws[i] - 1) // ws[i]) * 1000 + i
                      ELSE 1000000000 END)) % 1000 AS choice
        FROM play, lists WHERE slot + 1 < total)),
plan AS (SELECT p.slot, w.class, w.weight, w.n, p.done[w.k] - 1 AS block_no
         FROM play p JOIN w ON p.pick = w.k),
empty AS (SELECT min((n // {mixing.BLOCK}) // weight * total + slot) AS first_empty
          FROM plan, lists WHERE block_no = (n // {mixing.BLOCK}) % weight),
x AS (SELECT doc_id, source, row, row // {mixing.BLOCK} AS block, plan.slot AS own,
             (row // {mixing.BLOCK}) // weight AS turn, weight, block_no, total
      FROM numbered JOIN plan ON numbered.class = plan.class
           AND (row // {mixing.BLOCK}) % weight = block_no, lists)
SELECT doc_id, source, row, block, turn * total + own AS slot,
       turn * total + (block_no * total) // weight AS release,
       turn * total + ((block_no + 1) * total + weight - 1) // weight AS deadline,
       (turn * total + own) * {mixing.BLOCK} + row % {mixing.BLOCK} AS position,
       turn * total + own < first_empty AS on_target
FROM x, empty"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": SQL_URL, "op3_sharding": _sql_sharding(), "op5_source_mixing": SQL_MIXING,
            "op8_license_scan": license_scan.oracle()}
