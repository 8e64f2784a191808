"""A corpus pipeline of five stages over ``documents``; each stage works on all its predecessor kept.

Stages 1 to 4 return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.llm.line_dedup import remove_repeated_chunks
from polyview.llm.near_dedup import near_duplicates
from polyview.llm.packing import pack_documents
from polyview.llm.quality import score_quality
from polyview.llm.queries import surrogate_key
from polyview.llm.shared import drop_table, stage_table
from polyview.llm.surrogates import replace_entities


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the rules' posterior rejects go."""
    return score_quality(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated multi-line chunks go, but at their first place."""
    out = remove_repeated_chunks(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates the document with the smallest id stays.

    Here pairs of five-word similarity 0.8 or more count (the query op7_near_dedup: 0.85).  With 20 tables a pair of
    similarity 0.8 is missed with probability 5e-5.
    """
    gone = near_duplicates(docs, percent=80, tables=20).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data and secrets get surrogates."""
    out = replace_entities(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of at most 1024 tokens in as few sequences as found."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("surrogates", surrogates), ("packing", packing)]

#: Expectation-maximisation, minhashes and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_table(last)  # its successor is written
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
