"""The ``opN_`` queries and the pipeline: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding, filteraudit, html, langid, linededup, minhash, mixing, resample, secrets, suffix, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(_table(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digest(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The resampling by SQL.  CRC-32 goes by half bytes, the lower one first; sixteen fixed values are its table.
RESAMPLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), w AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, w FROM d UNION ALL SELECT -row_number() OVER (), w FROM b)
), g AS (
  SELECT r, array_to_string(w[i:i + k - 1], ' ') AS gram FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)
), n AS (SELECT r, gram, count(*) AS n FROM g GROUP BY ALL
), nib AS (
  SELECT gram, hex(encode(gram)) AS hx FROM (SELECT DISTINCT gram FROM n)
), c AS (
  SELECT gram, xor(list_reduce(list_transform(range(1, len(hx) + 1), lambda j: (instr('0123456789ABCDEF', hx[j + CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END]) - 1)::BIGINT),
    lambda s, x: xor(s >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(s, x) & 15) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM nib
), f AS (SELECT r, bucket, sum(n)::BIGINT AS n FROM n JOIN c USING (gram) GROUP BY ALL
), st AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM f GROUP BY ALL
), tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM st
), gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM st, tot
), sc AS (
  SELECT d.r, any_value(doc_id) AS doc_id, any_value(len(w)) AS words, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * gain), 0)::BIGINT AS weight FROM d LEFT JOIN f ON f.r = d.r LEFT JOIN gain USING (bucket) GROUP BY d.r
), so AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM sc
), ra AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k, 5 * count(*) FILTER (words >= 20) OVER () // 100 AS drawn FROM so)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= drawn THEN k END AS rank FROM ra
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_html, op3_minhash, op4_language, op5_suffix, op6_lines, op7_secrets, op8_mix, op9_embeddings, op10_topk, op11_resample, op12_audit, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op11_resample": RESAMPLE_SQL, "op12_audit": filteraudit.AUDIT_SQL}
