"""The corpus pipeline: five filtering and formatting stages over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents it keeps. ``run``
writes each stage's result as Parquet in the shared folder and reads it again, so no stage recomputes another and a lost
executor costs at most one stage; heaps are collected before each stage. All stages but the last return the columns of
``documents``; the last returns one row per document with its token ids.

Every stage takes what the one before it kept, with these cases defined: null and empty texts score below 0.5, are copies
of each other, lose nothing, hold no item and have no tokens; rows without doc_id pass every stage; of rows that repeat a
doc_id one passes the near-duplicate stage; an empty table gives an empty result; further columns pass through all stages
but the last.

The pipeline has no SQL counterpart (transducers, random walks and merges are not SQL); ``tests/llm`` holds it against a
composition of brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, decontaminate, shingles, suffix, toxicity
from loomspan.llm.common import fresh_path, made, rest, sweep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the grammar learns from the labels of the documents at hand."""
    rest(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash or prefixes of 5-word shingles (Jaccard 0.8 or more) the smallest doc_id stays."""
    rest(spark)
    return shingles.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in an earlier document are cut out; every document stays."""
    rest(spark)
    return suffix.drop_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a close edit of one, go."""
    rest(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids (little-endian unsigned 32-bit integers) of each text."""
    rest(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage made on its way goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for _, stage in STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark, keep=(*before, path))
    return docs
