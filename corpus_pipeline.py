"""A corpus pipeline: drop toxic documents, keep one of each group of near duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs. Fully equal rows are one document; a null doc_id, text or
source is allowed everywhere; an empty table stays empty; further columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import mixing, ngram_join, pieces, toxicity
from runledger.llm.common import fresh, once, row_key, stage, table
from runledger.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that a model learnt from their labels scores at 0.7 or more."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at similarity 0.8, directly or over others, the one with the smallest id stays.

    Of different ones that share that id, it's the one with the smallest row key. A document without words is its own group."""
    ship(spark)
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key(docs).alias("row")))
    groups = ngram_join.near_duplicates(keyed, words=5, num=80, den=100, doc_id=key)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return once(keyed.join(kept, key, "left_semi"), key).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their target weights."""
    ship(spark)
    return mixing.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, the score of their best segmentation and those of the next two."""
    ship(spark)
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_each_group), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]

#: The toxicity model, the sampling and the lattice search have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
