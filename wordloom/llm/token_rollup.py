"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are the sum of signed rows: an insert adds a
document's count, a delete subtracts it, a revised count subtracts the old and adds the new.
A batch is summed per group before it is stored, so a batch of any size leaves a few rows, and
totals come from these rows alone - texts of earlier batches are never read again.

Commits are idempotent: a batch id names a folder that counts only when its ``_SUCCESS``
marker exists. Committing an id again is a no-op; a folder without the marker (a lost driver)
is rewritten.

Defined cases: null source, language or version are groups of their own; a null or empty text
has 0 tokens; repeated rows count each; an empty batch commits no rows; further columns are
not read.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PIECE_PATTERN
from .shared import with_fields

GROUP = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def word_counts(pattern: str, text_col: str = "text") -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def bpe_counts(docs: DataFrame, columns: list[str], text_col: str = "text",
               ranks_path: str = RANKS_PATH) -> DataFrame:
    """``columns`` plus ``n_tokens`` under a public byte-level vocabulary. Each task loads the
    file once; ``ranks_path`` must exist on every worker."""
    schema = with_fields(docs.select(*columns).schema, "n_tokens long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in b.column("__text")]
            cols = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    return docs.select(*columns, F.col(text_col).alias("__text")).mapInArrow(count, schema)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as signed rows: +1 for inserts, -1 for deletes."""
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"),
                         (F.col("n_tokens") * sign).cast("long").alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows of a recount: the old counts leave, the new ones enter."""
    return signed(old, -1).unionByName(signed(new, 1))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, batch_id: str):
        if not batch_id or any(c in batch_id for c in "/\\:"):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.path}/batch-{batch_id}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch_id: str) -> bool:
        return self._exists(f"{self._path(batch_id)}/_SUCCESS")

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Add a batch of signed rows once; False if it was committed before."""
        if self.committed(batch_id):
            return False
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        (sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
         .write.mode("overwrite").parquet(self._path(batch_id)))
        return True

    def batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(f"{self.path}/{n}" for n in names if n.startswith("batch-")
                      and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents have all gone are dropped."""
        done = self.batches()
        deltas = (self.spark.read.schema(SCHEMA).parquet(*done) if done
                  else self.spark.createDataFrame([], SCHEMA))
        return (deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)))
