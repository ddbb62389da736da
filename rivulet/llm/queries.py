"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import chat, embnn, langid, mixing, packing, pii, secretscan, simhash, spans, tokenfile, topk


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(pii.detect(_docs(spark, sf_dir), with_text=False), pii.BASE, pii.BASE + pii.MORE, "score")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_token_files(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)
    return tokenfile.digest(tokenfile.read_token_files(files))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domain_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed, domains, report = mixing.mix(_docs(spark, sf_dir), labelled, tokenizer("word_bpe_49k.json"))
    of = lambda values, d: F.lit(values.get(d)).cast("double")
    each = []
    for d in sorted(mixing.TARGETS):
        each.append((F.col("mix_p")[domains.index(d)] if d in domains else F.lit(None).cast("double")).alias(f"p_{d}"))
        # what the fit aimed at and got, in expected tokens of all documents: a target that was missed shows here
        each += [of(report["target"], d).alias(f"target_{d}"), of(report["reached"], d).alias(f"reached_{d}")]
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *each, F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"), spaced=False, end_id=1))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(secretscan.detect(_docs(spark, sf_dir), with_text=False), secretscan.BASE, secretscan.ORDER, "cost")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.train(docs)).drop("bits")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embnn.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_chat, op3_token_files, op4_mixing, op5_packing, op6_secrets, op7_topk, op8_language, op9_simhash, op10_vectors)
}

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn,
         regexp_replace(coalesce(nullif(trim(role), ''), 'unknown'), '[^\p{L}\p{N}_.-]', '_', 'g') AS who,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1|>', 'g') AS said
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, who AS assistant FROM t WHERE who <> 'system'
), m AS (
  SELECT p.conv_id, p.assistant, t.turn, t.who, t.said, t.who = p.assistant AS own,
         '<|im_start|>' || CASE WHEN t.who = p.assistant THEN 'assistant' WHEN t.who = 'system' THEN 'system' ELSE 'user name=' || t.who END || chr(10) AS head,
         t.said || '<|im_end|>' AS body
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS lo
  FROM m
)
SELECT conv_id, assistant, count(*)::BIGINT AS n_turns, (count(*) FILTER (WHERE own))::BIGINT AS n_learned,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, who, said) AS rendered,
       string_agg(lo || ':' || (lo + length(body)), ',' ORDER BY turn NULLS FIRST, who, said) FILTER (WHERE own) AS mask
FROM o GROUP BY conv_id, assistant
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.w) = len(c.w) AND len(q.w) > 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM k WHERE n <= 5
"""

_CAPS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.component_id, r.vec_id = r.component_id AS kept FROM r LEFT JOIN d USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_chat": _CHAT_SQL, "op7_topk": _TOPK_SQL, "op10_vectors": _CAPS_SQL}
