"""Readers for the stand-in tables derived from the driver's parquet files.

Each derivation mirrors FIXTURES.md section 3 so the same rows can be rebuilt
in DuckDB for the oracle. Column pruning and filters reach the parquet scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .corpus import corpus_by_column

# Registry order of the language sources (fixed value): en, de, es, fr.
LANG_REGISTRY = ("en", "de", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table, pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread_thin(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than cores, dealt over the cores: a file of one row group is read by
    one task, however long its texts. A scan that fills the cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str, max_docs: int | None = None) -> DataFrame:
    """``(source, ord, doc_id, text)``: documents split into one source per language."""
    docs = spread_thin(table(spark, sf_dir, "documents", ["doc_id", "lang", "text"]))
    return corpus_by_column(docs, "lang", LANG_REGISTRY, max_docs=max_docs)


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice rows (question, opa..opd, cop, exp) with planted gaps."""
    p = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    k = F.col("p_partkey")
    return p.select(
        k.alias("row_id"),
        F.concat(F.lit("  Which brand is "), F.col("p_name"), F.lit(" number "),
                 k.cast("string"), F.lit("? ")).alias("question"),
        F.col("p_brand").alias("opa"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.col("p_type")).alias("opb"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("opc"),
        F.col("p_size").cast("string").alias("opd"),
        F.when(k % 13 == 0, F.lit(None).cast("int")).otherwise((k % 4).cast("int")).alias("cop"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
         .when(k % 3 == 1, F.concat(F.lit(" Listed as "), F.col("p_type"), F.lit(". ")))
         .otherwise(F.lit("   ")).alias("exp"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no/maybe rows (question, final_decision, long_answer)."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    k = F.col("o_orderkey")
    m5 = k % 5
    return o.select(
        k.alias("row_id"),
        F.when(k % 23 == 0, F.lit("  "))
         .otherwise(F.concat(F.lit("Is order "), k.cast("string"), F.lit(" open? "))).alias("question"),
        F.when(m5 == 0, F.lit("yes")).when(m5 == 1, F.lit(" NO ")).when(m5 == 2, F.lit("maybe"))
         .when(m5 == 3, F.lit("")).otherwise(F.lit(None).cast("string")).alias("final_decision"),
        F.when(k % 29 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" Status "), F.col("o_orderstatus"), F.lit(", priority "),
                             F.col("o_orderpriority"), F.lit(". "))).alias("long_answer"),
    )


def instr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows: each user turn followed by an assistant turn; the
    conversation's system turn, if any, is the input."""
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    w = Window.partitionBy("conv_id").orderBy("turn")
    wc = Window.partitionBy("conv_id")
    t = c.select(
        "conv_id", "turn", "role", "text",
        F.lead("text").over(w).alias("nxt"),
        F.lead("role").over(w).alias("nrole"),
        F.max(F.when(F.col("role") == "system", F.col("text"))).over(wc).alias("sys"))
    return t.filter((F.col("role") == "user") & (F.col("nrole") == "assistant")).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
        F.col("text").alias("instruction"),
        F.coalesce(F.col("sys"), F.lit("")).alias("input"),
        F.col("nxt").alias("output"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-metrics log rows: one run per event type, 24 eval steps, repeats."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    v = F.col("value")
    return e.select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("ingest_seq"),
        (F.lit(250) * (F.col("event_id") % 24 + 1)).alias("step"),
        v.alias("train_loss"),
        F.lit(0.0008).cast("double").alias("lr"),
        ((v + v * 1.25) / 2).alias("val_avg"),
        v.alias("val_en"),
        (v * 1.25).alias("val_de"),
        F.col("ts"),
    )


def metrics_scheduled(spark: SparkSession, sf_dir: str, sched, fault_every: int) -> DataFrame:
    """The metrics log with ``lr`` as the schedule at ``step - 1`` and a
    deliberate error (x1.5) on every ``fault_every``-th ingested row (G6)."""
    m = metrics(spark, sf_dir)
    exp = sched.at(F.col("step") - 1)
    return m.withColumn("lr", F.when(F.col("ingest_seq") % fault_every == 0, exp * 1.5)
                        .otherwise(exp))
