"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, html_extract, jaccard, packing, perspectives, quality, repair, substrings, tokenstore, topk, toxicity, whitening
from .common import documents


#: Score from which a document counts as toxic.
TOXIC = 0.3
#: Score from which a document counts as good.
GOOD = 0.5


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return topk.search(queries, vectors, k=20)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), n_gram=5, num=80, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_matches")


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rank_file, pattern = _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.decode(bpe.encode(documents(spark, sf_dir), rank_file, pattern), rank_file, pattern))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir), width=20)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenstore.new_path(spark)
    tokenstore.write_store(documents(spark, sf_dir), path, _vocabulary("byte_bpe_50k.json"), end_id=0)
    return tokenstore.digest(tokenstore.read_store(spark, path))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_jaccard": op2_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_perspectives": op4_perspectives,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_substrings": op7_substrings,
    "op8_token_output": op8_token_output,
    "op9_fingerprints": op9_fingerprints,
    "op10_html": op10_html,
    "op11_repair": op11_repair,
    "op12_quality": op12_quality,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op11_repair": repair.ORACLE,
    "op4_perspectives": """
        WITH s AS (
            SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE replace(replace(trim(role), '<|', '< |'), '|>', '| >') END AS speaker,
                   replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
        ), t AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY speaker, text) AS INTEGER) AS place FROM s
        ), m AS (
            SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
            FROM t JOIN (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM s WHERE speaker <> 'system') p ON t.conv_id IS NOT DISTINCT FROM p.c
        ), h AS (
            SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM m
        )
        SELECT conv_id, perspective, turn, place, role, head || text || '<|end|>' || chr(10) AS segment,
               CAST(CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS INTEGER) AS target_start,
               CAST(CASE WHEN role = 'assistant' THEN length(text) + 8 ELSE 0 END AS INTEGER) AS target_length
        FROM h""",
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
