"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, line_dedup, lm_scoring, mixing, packing, quality_rules, simhash, surrogates, tiff, tokens

WORDS = r"[^\x20\x09-\x0D]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_documents(spark, sf_dir)).drop("t")


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tiff.store_texts(_documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    return tiff.digest(tiff.pages(files, "media", keep), keep)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.lm_scores(_documents(spark, sf_dir))
    # rounded, as sums of doubles depend on their order
    return found.withColumn("log_score", F.round("log_score", 5)).withColumn("mean_log_score", F.round("mean_log_score", 7))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir)).drop("cleaned")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_rows")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_source_mixing, op3_token_counts, op4_chat_formatting, op5_line_dedup, op6_media_tiff, op7_pii_surrogates, op8_lm_scoring, op9_quality_rules, op10_simhash, pipeline)
}

ORACLES: dict[str, str] = {}

ORACLES["op4_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '<</ROLE>>' END AS stop,
         CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS marks,
         length(regexp_replace(text, '(\[/?|<{1,2}/?)(\\*)(INST\]|s>|SYS>>|ROLE)', '\1\\\2\3', 'g')) AS escaped_length
  FROM rows),
whole AS (SELECT *, bool_or(contains(text, stop) OR regexp_matches(text, '(\[/?|<{1,2}/?)\\+(INST\]|s>|SYS>>|ROLE)')) OVER (PARTITION BY conv_id) AS esc FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(marks + CASE WHEN esc THEN escaped_length ELSE length(text) END)::BIGINT AS formatted_chars,
       bool_or(esc) AS escaped, true AS exact
FROM whole GROUP BY conv_id"""

ORACLES["op8_lm_scoring"] = rf"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
grams AS (SELECT doc_id, i, w, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM grams GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM grams WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM grams WHERE u IS NOT NULL GROUP BY u, v, w),
scored AS (
  SELECT g.doc_id, least(i, 3) AS could,
         CASE WHEN c3.n >= {lm_scoring.MIN_COUNT} THEN 3 WHEN c2.n >= {lm_scoring.MIN_COUNT} THEN 2 ELSE 1 END AS used,
         CASE WHEN c3.n >= {lm_scoring.MIN_COUNT} THEN ln(c3.n / h2.n) WHEN c2.n >= {lm_scoring.MIN_COUNT} THEN ln(c2.n / h1.n) ELSE ln(c1.n / (SELECT count(*) FROM grams)) END AS s
  FROM grams g JOIN c1 ON g.w = c1.w LEFT JOIN c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w
  LEFT JOIN c1 h1 ON g.v = h1.w LEFT JOIN c2 h2 ON g.u = h2.v AND g.v = h2.w),
summed AS (
  SELECT doc_id, count(*) AS n_words, sum(s + (could - used) * ln({lm_scoring.ALPHA})) AS log_score, sum((used < could)::INT)::BIGINT AS n_backed_off FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0), 5) AS log_score, round(coalesce(log_score / n_words, 0), 7) AS mean_log_score,
       coalesce(n_backed_off, 0) AS n_backed_off
FROM documents d LEFT JOIN summed USING (doc_id)"""

_BOILERPLATE = "|".join(quality_rules.BOILERPLATE)
_TERMINAL = quality_rules.TERMINAL.replace("'", "''")
ORACLES["op9_quality_rules"] = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts)),
shingles AS (
  SELECT doc_id, i, hash(w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS h, lead(w, 4) OVER d AS e
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM shingles WHERE e IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts)),
judged AS (
  SELECT doc_id, l, len(w) AS n, length(array_to_string(w, '')) AS chars, len(regexp_extract_all(l, '[#*$%&|<>]')) AS symbols,
         len(w) > 0 AND (
           (len(w) < {quality_rules.SHORT_LINE_WORDS} AND NOT regexp_matches(w[-1], '{_TERMINAL}'))
           OR len(regexp_extract_all(l, '[#*$%&|<>]')) * 100 > len(w) * {quality_rules.MAX_SYMBOLS_PER_100_WORDS}
           OR len(regexp_extract_all(l, '!!')) * 100 > len(w) * {quality_rules.MAX_BANGS_PER_100_WORDS}
           OR (len(w) >= {quality_rules.SHORT_LINE_WORDS} AND upper(l) = l AND lower(l) <> l)
           OR (len(w) >= {quality_rules.LONG_LINE_WORDS} AND len(list_distinct(w)) * 100 < len(w) * {quality_rules.MIN_DISTINCT_PERCENT})
           OR (len(w) < {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(lower(l), '{_BOILERPLATE}'))) AS fails
  FROM lines),
docs AS (
  SELECT doc_id, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
         (count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0)) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
         coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY doc_id),
final AS (
  SELECT docs.*, coalesce(covered.n, 0) AS n_repeat_words,
         n_words < {quality_rules.MIN_WORDS} OR coalesce(covered.n, 0) * 100 > n_words * {quality_rules.MAX_REPEAT_PERCENT} AS base_failed
  FROM docs LEFT JOIN covered USING (doc_id))
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {quality_rules.MAX_LOST_PERCENT} AS kept FROM final"""
