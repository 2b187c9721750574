"""From raw documents to packed sequences: each stage is one operator over all that the one before kept.

Toxic documents go, one document of each group of near copies stays, passages that repeat across
documents are removed, and the rest is packed. STAGES are functions (spark, docs, sf_dir) -> DataFrame;
`run` writes each result to the shared folder and reads it again, so that a lost executor costs no
finished stage.

Nulls and edge cases are those of the operators: rows without text have no words, so they are no copies, lose
nothing and are packed as one end id; a row without doc_id stays; equal rows are one; columns other than text
and n_chars stay as they are up to the last stage; without labels of both kinds no document
is rejected as toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import jaccard, packing, substrings, toxicity
from lectern.llm.common import materialize
from lectern.llm.queries import TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n_gram=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut(docs, width=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: SQL has neither the learned model nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
