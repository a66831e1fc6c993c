"""One query for each operator of this subpackage, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bitsliced, bloom_lm, bpe, convnet, html_lstm, licenses, merkle, mixing, ngram_join, preference
from folioframe.llm._spark import table

#: Vocabulary file of the query for operator 10, by name.
RANKS = "byte_bpe_50k.tiktoken"


def op1_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convnet.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, fold=1)


def op2_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``source/lang/doc_id.txt``."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents"), path, F.col("text"), threshold=0.75, carry=("doc_id",))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.link(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.with_next_answer(table(spark, sf_dir, "conversations"))
    return preference.pairs(turns, *(F.col(c) for c in ("pair_id", "side", "turn", "role", "text")))


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"), folds=10).withColumnRenamed("id", "doc_id")


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_convnet": op1_byte_convnet,
    "op2_html_lstm": op2_html_lstm,
    "op3_mixing": op3_mixing,
    "op4_licenses": op4_licenses,
    "op5_ngram_join": op5_ngram_join,
    "op6_bit_sliced_top_k": op6_bit_sliced_top_k,
    "op7_preference": op7_preference,
    "op8_bloom_lm": op8_bloom_lm,
    "op9_merkle": op9_merkle,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT source, total, total * 3 AS cap, sum(total) OVER ()::BIGINT AS everything,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM w),
r AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM f),
t AS (SELECT source, total, least(coalesce((SELECT arg_min(rate, place) FROM r WHERE rate * weight <= cap) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM r),
p AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS n FROM t),
c AS (SELECT d.doc_id, d.size, p.total, p.target, p.n, p.target - p.n * p.total AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS here
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       size * (n + CASE WHEN upto <= rest OR (upto - here <= rest AND abs(upto - rest) < abs(upto - here - rest)) THEN 1 ELSE 0 END) AS taken
FROM c""",
    "op4_licenses": licenses.sql("documents", "concat_ws('/', source, lang, doc_id || '.txt')", "text", 0.75, "doc_id"),
    "op5_ngram_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT r, doc_id, len(s) AS n FROM s),
e AS (SELECT r, unnest(s) AS x FROM s),
o AS (SELECT a.r, b.r AS q, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
l AS (SELECT o.r, o.q FROM o JOIN n a ON a.r = o.r JOIN n b ON b.r = o.q WHERE 100 * o.c >= 90 * (a.n + b.n - o.c)),
reach(r, q) AS (SELECT r, q FROM l UNION SELECT reach.r, l.q FROM reach JOIN l ON l.r = reach.q),
c AS (SELECT reach.r, min(n.doc_id) AS c FROM reach JOIN n ON n.r = reach.q GROUP BY 1),
d AS (SELECT r, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(least(doc_id, c), doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM n LEFT JOIN c USING (r) LEFT JOIN d USING (r)""",
    "op6_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64.0 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op7_preference": preference.SQL,
}
