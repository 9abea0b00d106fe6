"""Corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), reads everything its predecessor kept and returns the columns of
``documents``; the last returns packed pieces. ``run`` writes each stage's result to the session's shared
checkpoint folder and rereads it, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallgrid.llm.common import shared_checkpoints
from stallgrid.llm.decontaminate import drop_leaks
from stallgrid.llm.language_id import fit_centroids, identify
from stallgrid.llm.ngram_join import keep_representatives
from stallgrid.llm.packing import pack_pieces, token_pieces
from stallgrid.llm.suffix_dedup import drop_repeats

ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` becomes the recognised one."""
    model = fit_centroids(docs.select("doc_id", "text", "lang"))
    known = identify(docs, model).where(~F.col("rejected"))
    return known.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return keep_representatives(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in a smaller one; n_chars follows the text."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_pieces(token_pieces(docs))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("suffix_dedup", repeat_stage),
    ("decontaminate", leak_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of what is left."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
