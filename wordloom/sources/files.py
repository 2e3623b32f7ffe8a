"""Sinks and sources (A5-A9): token blocks, tokenizer tables, chat JSONL, metrics JSONL.

Everything is written by executors straight to the target folder (no driver
round trip). Scratch output of the registered queries goes under the
session's shared checkpoint folder.
"""
from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import null_safe_join
from ..operators.bpe import BpeModel
from ..operators.tokens import guarded, to_blocks, watched
from ..session import checkpoint_dir

CHAT_SCHEMA = T.StructType([T.StructField("source", T.StringType()),
                            T.StructField("row_id", T.LongType()),
                            T.StructField("user", T.StringType()),
                            T.StructField("assistant", T.StringType())])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


# --- A5: token blocks ------------------------------------------------------------------

def write_blocks(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by source and split. Range partitioning on
    ``(source, split, block_id)`` spreads even the largest source over many
    writer tasks, and each file then holds one contiguous, sorted block-id
    range, so a window read can skip row groups by their statistics."""
    (blocks.repartitionByRange("source", "split", "block_id")
     .sortWithinPartitions("source", "split", "block_id")
     .write.mode(mode).partitionBy("source", "split").parquet(path))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("source", "split", "block_id", "toks")


# --- D6: blocks for loaders -------------------------------------------------------------

BLOCK_KEYS = ("source", "split", "block_id")


def _block_table(path: str) -> str:
    return "blocks_" + hashlib.md5(path.encode()).hexdigest()


def store_buckets(segments: DataFrame, path: str, buckets: int | None = None, vocab_size: int = 1 << 16,
                  build: Observation | None = None) -> DataFrame:
    """Blocks of ``segments`` stored bucketed by ``(source, split, block_id)``, a file a bucket. A join
    on these keys reads the stored side where it lies: only the windows are shuffled. The
    blocks are put together in the buckets' own partitioning, so the write moves nothing
    either. ``buckets`` should be as many as the readers' shuffle partitions or more. Ids are
    guarded (C6), and ``build`` watches the write (C4)."""
    spark = segments.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = guarded(to_blocks(segments, buckets=n), vocab_size)
    (watched(blocks, build or Observation()).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(n, *BLOCK_KEYS).sortBy(*BLOCK_KEYS).saveAsTable(_block_table(path)))
    spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}-layout")
    return read_buckets(spark, path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The stored blocks with their buckets; a session that did not write them is told the layout."""
    name = _block_table(path)
    if not spark.catalog.tableExists(name):
        n = spark.read.schema("buckets int").json(f"{path}-layout").first()["buckets"]
        keys = ", ".join(BLOCK_KEYS)
        spark.sql(f"create table {name} (source string, split string, block_id bigint, toks array<int>) using parquet "
                  f"clustered by ({keys}) sorted by ({keys}) into {n} buckets location '{path}'")
    return spark.table(name).select(*BLOCK_KEYS, "toks")


# --- A6: build only what is absent --------------------------------------------------------

MANIFEST = "source string, split string, blocks bigint, build string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(source, split, blocks, build)`` of all committed builds. A build counts once its manifest
    is there, which is written last; of two builds of one source the first by name counts."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    first = rows.filter("split = 'train' and blocks > 0").groupBy("source").agg(F.min("build").alias("build"))
    return null_safe_join(rows, first, ["source", "build"])


def built_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources whose train output is committed and not empty (val is not checked)."""
    return manifest(spark, path).select("source").distinct()


def read_built(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of committed builds; what an unfinished build left is not read."""
    done = manifest(spark, path).select("source", "build").distinct()
    builds = [r["build"] for r in done.select("build").distinct().collect()]          # a row per build
    out = spark.createDataFrame([], "source string, split string, block_id bigint, toks array<int>")
    for build in builds:
        own = done.filter(F.col("build") == build).drop("build")
        out = out.unionByName(null_safe_join(read_blocks(spark, f"{path}/blocks/{build}"), F.broadcast(own), ["source"]))   # a row per source
    return out


def build_if_absent(corpus: DataFrame, build, path: str) -> DataFrame:
    """Run ``build(corpus_subset) -> blocks`` only for sources not yet built. Returns the list
    of sources built (one row per source).

    The blocks go to a folder of their own and count only once the manifest names them: a
    build that dies half-way is not seen by readers, and the next call builds its sources anew."""
    spark = corpus.sparkSession
    built = F.broadcast(built_sources(spark, path).withColumnRenamed("source", "__s"))          # a row per source: no shuffle by source
    todo = corpus.join(built, F.col("source").eqNullSafe(F.col("__s")), "left_anti")
    names = todo.select("source").distinct().collect()          # a row per source
    if names:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        staged = f"{path}/blocks/{name}"
        write_blocks(build(todo), staged, mode="errorifexists")
        counts = read_blocks(spark, staged).groupBy("source", "split").agg(F.count(F.lit(1)).alias("blocks"))
        (counts.withColumn("build", F.lit(name)).coalesce(1).write.parquet(f"{path}/manifest/{name}"))
    return spark.createDataFrame(names, "source string")


# --- A7: tokenizer tables ---------------------------------------------------------------------

def save_tokenizer(spark: SparkSession, model: BpeModel, path: str) -> None:
    model.merges_df(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "merges"))
    model.vocab_df(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "vocab"))


def load_tokenizer(spark: SparkSession, path: str) -> BpeModel:
    """The merge table is bounded by the vocabulary (<= 65,536 rows)."""
    return BpeModel.from_merges_df(spark.read.parquet(os.path.join(path, "merges")))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "vocab"))


def tokenizer_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(os.path.join(path, "merges")).limit(1).count()
        return True
    except AnalysisException:
        return False


# --- A8: chat pairs as JSON lines --------------------------------------------------------------

def write_chat_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8 (Spark keeps non-ASCII unescaped; the
    decoded strings are the same)."""
    df.select("source", "row_id", "user", "assistant").write.mode("overwrite").json(path)


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT_SCHEMA).json(path)


# --- A9: run metrics JSON lines ----------------------------------------------------------------

def write_metrics_jsonl(log: DataFrame, path: str) -> None:
    """Append-only log per run: ``<path>/run=<name>/*.json``."""
    log.write.mode("append").partitionBy("run").json(path)


def read_metrics_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(run, row)``: each line as a VARIANT. Runs may log different keys, and new ones later: no
    pass over the logs finds a schema first. The run name comes from the folder; blank and
    broken lines are skipped."""
    lines = spark.read.schema("value string, run string").text(path)
    return lines.select("run", F.try_parse_json("value").alias("row")).filter("row is not null")


def metric_columns(logs: DataFrame, series: Sequence[str]) -> DataFrame:
    """``(run, step, ingest_seq, *series)``; a series that a run never logged is null."""
    field = lambda k, t: F.try_variant_get("row", f"$.{k}", t).alias(k)
    return logs.select("run", field("step", "bigint"), field("ingest_seq", "bigint"), *[field(k, "double") for k in series])


def metric_series(logs: DataFrame) -> DataFrame:
    """G1 from the lines: ``(run, step, ingest_seq, series, value)`` for each ``val_*`` key and
    ``train_loss`` a line has."""
    spark = logs.sparkSession
    keys = logs.lateralJoin(spark.tvf.variant_explode(F.col("row").outer()))
    keys = keys.filter(F.col("key").startswith("val_") | (F.col("key") == "train_loss"))
    field = lambda k: F.try_variant_get("row", f"$.{k}", "bigint").alias(k)
    value = F.try_variant_get("value", "$", "double")
    return keys.select("run", field("step"), field("ingest_seq"), F.col("key").alias("series"), value.alias("value")).filter(
        "value is not null")


def ensure_tokenizer(spark: SparkSession, path: str, train) -> BpeModel:
    """A6 for the tokenizer: load the tables when present, else ``train()``
    and save them, so a rerun never retrains."""
    if tokenizer_exists(spark, path):
        return load_tokenizer(spark, path)
    model = train()
    save_tokenizer(spark, model, path)
    return model
