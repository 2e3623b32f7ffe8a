"""Structured Streaming forms.

Each job reads files incrementally (``maxFilesPerTrigger``), keeps its
progress and state in a checkpoint under the shared checkpoint folder, and
runs with ``trigger(availableNow=True)`` so a batch caller can drain what is
there and stop. Aggregation state lives in RocksDB, not on the JVM heap.
"""
from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import pieces
from ..operators.tokenizer import TRAIN_CHAR_CAP
from ..sources.corpus import corpus_by_column
from .state import LastWinsBest, SmallestDocs, smallest_of_each

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder)


def ingest_corpus(stream: DataFrame, source_col: str, registry: Sequence[str], out: str,
                  checkpoint: str) -> None:
    """Text resolution and the non-blank filter, stateless, appended
    to parquet. The per-source doc cap is not applied here: it needs the whole
    order, so it stays in the batch scan."""
    c = corpus_by_column(stream, source_col, registry)
    q = (c.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()


def _epoch_sink(out: str):
    """Each trigger's changed rows go to ``<out>/epoch=<id>``; rewriting one
    epoch on a retry is idempotent, and nothing earlier is rewritten."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
    return write


def latest(spark: SparkSession, out: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The current table of an update-mode sink: per key, the values of the
    latest epoch that touched it (state values are cumulative)."""
    df = spark.read.parquet(out)
    newest = F.max_by(F.struct(*values), F.col("epoch"))
    return df.groupBy(*keys).agg(newest.alias("__v")).select(*keys, "__v.*")


def piece_counts_stream(stream: DataFrame, source_col: str, registry: Sequence[str], out: str,
                        checkpoint: str) -> None:
    """Running piece counts (B3 + B4 on capped text) kept in RocksDB
    state; update mode emits only the pieces a trigger changed. All documents
    count: B4's limit of documents per source needs their whole order."""
    c = corpus_by_column(stream, source_col, registry)
    counts = (c.select(F.explode(pieces(F.substring("text", 1, TRAIN_CHAR_CAP))).alias("piece"))
              .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    q = (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(_epoch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()


def run_best_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """S3: lowest ``val_avg`` per run over every logged row (before the
    last-wins de-duplication of G4), updated per trigger."""
    best = stream.groupBy("run").agg(F.min("val_avg").alias("best_val"),
                                     F.count(F.lit(1)).alias("rows"))
    q = (best.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(_epoch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()


def _keyed_state(spark: SparkSession) -> None:
    """Arbitrary keyed state is kept in RocksDB only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def capped_piece_counts_stream(stream: DataFrame, source_col: str, registry: Sequence[str], max_docs: int,
                               out: str, checkpoint: str) -> None:
    """S2 with B4's limit: counts over the ``max_docs`` first documents of each source by id, as
    files come in any order. A trigger first keeps each task's own smallest documents, so a
    source sends at most ``max_docs`` rows a task to its state; the state answers with the
    documents that came in (+1) and those they pushed out (-1), whose pieces are summed by
    sign and appended under the trigger's epoch. ``summed`` reads the table."""
    _keyed_state(stream.sparkSession)
    c = corpus_by_column(stream, source_col, registry)
    known = F.col("source").isNotNull()
    c = c.select(F.coalesce("source", F.lit("")).alias("source"), known.alias("known"), "doc_id",
                 F.xxhash64("text").alias("tie"), F.substring("text", 1, TRAIN_CHAR_CAP).alias("text"))
    near = c.mapInPandas(smallest_of_each(["source", "known"], max_docs), c.schema)
    moved = near.groupBy("source", "known").transformWithStateInPandas(
        SmallestDocs(max_docs), "text string, sign bigint", "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.explode(pieces(F.col("text"))).alias("piece"), "sign")
        rows.groupBy("piece").agg(F.sum("sign").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (moved.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()


def summed(spark: SparkSession, out: str, keys: Sequence[str], value: str) -> DataFrame:
    """The current table of a sink of signed changes: the sums that are left."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


def deduped_best_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """S3 after G4: lowest ``val_avg`` per run when a step logged again replaces its earlier row. The
    state keeps each step's last row, so a replaced value no longer counts, even if it was
    the best."""
    _keyed_state(stream.sparkSession)
    best = stream.select("run", "step", "ingest_seq", "val_avg").groupBy("run").transformWithStateInPandas(
        LastWinsBest(), "run string, best_val double, steps bigint", "Update", "None")
    q = (best.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(_epoch_sink(out)).trigger(availableNow=True).start())
    q.awaitTermination()


def sub(base: str, *names: str) -> str:
    return os.path.join(base, *names)
