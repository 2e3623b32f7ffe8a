"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Every stage takes all its predecessor kept and returns the columns of ``documents``; the last
adds what the mix took. Empty tables pass through.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, mixing, similarity, surrogates, toxicity
from wordloom.llm.shared import shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored ``THRESHOLD`` or more go; the model is fitted on labelled documents
    outside the held-out fold."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, net, docs.columns, out="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return similarity.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; mostly contaminated documents go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.anonymize(docs, surrogates.session_key(spark), report=False)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with ``size, source_size, target, taken``."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", cut_benchmark),
          ("personal_data", replace_personal_data), ("mix", mix_to_targets)]

#: A trained network, minhash runs and keyed surrogates are no SQL; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
