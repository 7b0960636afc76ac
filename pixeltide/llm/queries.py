"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, jaccard_join, language_id, lm_score, quality_classifier, quality_rules, substring_dedup, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(_table(spark, sf_dir, "documents"), length=50)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
g AS (SELECT doc_id, p, t[p + 1:p + 50] AS piece FROM (SELECT doc_id, t, unnest(range(0, n_bytes - 49)) AS p FROM d)),
f AS (SELECT piece, min(doc_id) AS first_id FROM g GROUP BY piece HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM g JOIN f USING (piece) WHERE doc_id > first_id),
r AS (SELECT doc_id, p, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i FROM s),
j AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
         string_agg(CASE WHEN i = 1 THEN hex(t[1:a]) ELSE '' END || hex(t[b + 1:coalesce(next_a, n_bytes)]), '' ORDER BY a) AS rest
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, hex(t)))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(led, quality_rules.POLICIES["strict-1"])
    base = quality_rules.POLICIES["base-1"].mask
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        "kept", "fail_bits", "n_lines", "n_upper",
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram
  FROM d WHERE len(w) >= 3),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_lines, n_upper
FROM b
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = language_id.held_out()
    names, table = language_id.fit(docs.filter(~out).select("doc_id", "text", "lang"), path)
    return language_id.predict(docs, names, table, path).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS piece
  FROM conversations),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(piece, '' ORDER BY k) AS rendered FROM t GROUP BY conv_id),
p AS (
  SELECT DISTINCT array_to_string(list_slice(l, 1, i), '') AS prefix, i
  FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT conv_id, list(piece ORDER BY k) AS l FROM t GROUP BY conv_id))),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*)::BIGINT AS n_copies, rendered FROM c GROUP BY n_turns, rendered)
SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = u.rendered AND p.i = u.n_turns)
"""


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), language_id.held_out(parts=5, part=1))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"), size=5, percent=75)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n_shingles FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM c JOIN n AS m ON m.doc_id = x JOIN n AS o ON o.doc_id = y
  WHERE 100 * common >= 75 * (m.n_shingles + o.n_shingles - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT doc_id, coalesce(n_shingles, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_lm_score": op8_lm_score,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL = {"op2_suffix_dedup": OP2_SQL, "op4_quality_rules": OP4_SQL, "op7_chat_format": OP7_SQL, "op10_jaccard_join": OP10_SQL}
