"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads it
back for the next one. The first four stages return the columns of documents, the last one the pieces of the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import langid, mixing, nearcopies, packing, secretscan
from rivulet.llm.common import materialise
from rivulet.llm.queries import tokenizer
from rivulet.session import spread

#: What the mixing stage does to the tokens of each domain: toxic text goes, all other text stays.
MULTIPLY = {"toxic": 0.0}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; the others go.

    Null texts, empty ones and texts without a letter are in none and go; texts of any length are read whole; repeated rows
    stay or go together; ties between languages do not matter; other columns pass through; an empty table gives no rows.
    """
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Five-word shingles, similarity 0.8.

    Null and empty texts are one group; texts of any length are compared whole; of rows that tie for the smallest doc_id,
    repeated ones among them, the first written one stays, and null doc_ids come last; columns may have any names; an empty
    table gives no rows.
    """
    return nearcopies.one_of_each(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by [SECRET].

    Null and empty texts stay as they are; texts and secrets of any length are handled whole; repeated rows are redacted
    alike, so there are no ties; other columns but n_chars pass through; an empty table gives no rows.
    """
    return secretscan.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned out to the target mixture of domains, as learned from the labels table.

    Null and empty texts count as one token; texts of any length are read whole; repeated rows have equal rates, and ties are
    decided by a hash of doc_id; other columns pass through; without labels all documents stay; an empty table gives no rows.
    """
    return mixing.thin(docs, mixing.domain_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), tokenizer("word_bpe_49k.json"), MULTIPLY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packing, as in query op5_packing.

    Null and empty texts become the end id alone; texts of any length are packed whole; repeated rows and rows that tie are
    documents of their own, in the order in which they lie; other columns are dropped; an empty table gives no rows.
    """
    return packing.digest(packing.pack(docs, tokenizer("word_bpe_49k.json"), spaced=False, end_id=1))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packed", packed)]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
