"""The operators as queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import (
    conversation_repair,
    fertility,
    fill_middle,
    fingerprints,
    language,
    minhash,
    mixing,
    packing,
    sharding,
    suffix_dedup,
    token_counts,
    url_reputation,
    warc,
)
from factloom.llm.common import table

URL_RULES = [
    url_reputation.Rule("block", "net", "/"),
    url_reputation.Rule("allow", "example.net", "/en/"),
    url_reputation.Rule("block", "example.com", "/de/"),
    url_reputation.Rule("allow", "org", "/fr/"),
]


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeated_strings(table(spark, folder, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), limit=2048)


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_shard_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, folder, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), k=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_reputation.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_fertility_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = fertility.judge(table(spark, folder, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*base)


def op11_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations")
    return conversation_repair.repair(conversation_repair.damage(chats), also=chats.select("conv_id"))


def op12_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"), least_bytes=0)


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.fill_middle(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_remove_repeats,
        op3_pack_sequences,
        op4_token_counts,
        op5_language,
        op6_shard_by_bytes,
        op7_near_duplicates,
        op8_url_filter,
        op9_fingerprints,
        op10_fertility_rules,
        op11_repair_conversations,
        op12_arc_to_warc,
        op13_fill_middle,
    )
}

#: Only the url filter is plain SQL; the others are tested against brute force, round trips or held-out rows.
ORACLES = {
    "op8_url_filter": r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT doc_id, quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL),
h0 AS (
  SELECT host, coalesce(sum(CASE WHEN quality > 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END), 0)::HUGEINT AS k,
         count(quality)::HUGEINT AS n, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host),
h1 AS (
  SELECT *, regexp_extract(name, '((?:[^.]+\.){1}[^.]+)$', 1) AS two, regexp_extract(name, '((?:[^.]+\.){2}[^.]+)$', 1) AS three,
         regexp_matches(name, '^[0-9.]*$') AS digits FROM h0),
h AS (
  SELECT host, k, n,
         CASE WHEN digits THEN name WHEN known THEN CASE WHEN three = '' THEN name ELSE three END
              WHEN two = '' THEN name ELSE two END AS domain,
         CASE WHEN digits THEN '' WHEN known THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix
  FROM (SELECT *, two IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'co.nz', 'com.br', 'co.in', 'co.za') AS known FROM h1)),
d AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM d GROUP BY ALL),
pairs AS (
  SELECT 1 AS level, '' AS parent, k, n FROM s UNION ALL SELECT 2, suffix, k, n FROM d UNION ALL SELECT 3, domain, k, n FROM h),
parents AS (
  SELECT level, parent, sum(k)::HUGEINT AS pk, sum(n)::HUGEINT AS pn, sum(k::HUGEINT * k::HUGEINT)::HUGEINT AS kk, sum(n::HUGEINT * n::HUGEINT)::HUGEINT AS nn
  FROM pairs GROUP BY ALL),
moments AS (
  SELECT level, sum(kk - pk)::DOUBLE AS same_good, sum(nn - pn)::DOUBLE AS same, sum(pk * pk - kk)::DOUBLE AS mixed_good,
         sum(pn * pn - nn)::DOUBLE AS mixed, sum(pk)::DOUBLE AS good, sum(pn)::DOUBLE AS total
  FROM parents GROUP BY level),
strengths AS (
  SELECT level, good, total,
         CASE WHEN same = 0 OR mixed = 0 THEN 1000.0::DOUBLE
              WHEN same_good / same <= mixed_good / mixed THEN 1000.0::DOUBLE
              ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (good / total - same_good / same) / (same_good / same - mixed_good / mixed))) END AS w
  FROM moments),
w AS (
  SELECT max(CASE WHEN level = 1 THEN w END) AS w1, max(CASE WHEN level = 2 THEN w END) AS w2, max(CASE WHEN level = 3 THEN w END) AS w3,
         max(CASE WHEN level = 1 THEN (good + 1.0::DOUBLE) / (total + 2.0::DOUBLE) END) AS root FROM strengths),
sm AS (SELECT suffix, (k::DOUBLE + w1 * root) / (n::DOUBLE + w1) AS suffix_mean FROM s, w),
dm AS (SELECT domain, suffix, (k::DOUBLE + w2 * suffix_mean) / (n::DOUBLE + w2) AS prior FROM d JOIN sm USING (suffix), w),
hm AS (SELECT host, (k::DOUBLE + w3 * prior) / (n::DOUBLE + w3) AS mean, n::DOUBLE + w3 AS total FROM h JOIN dm USING (domain, suffix), w),
r AS (
  SELECT p.page_id, p.host, p.path, mean - 1.645::DOUBLE * sqrt(mean * (1.0::DOUBLE - mean) / (total + 1.0::DOUBLE)) AS bound,
         CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p JOIN hm USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict
FROM r
""",
}
