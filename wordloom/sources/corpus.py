"""Corpus scans (A1-A3): named sources -> one ``(source, ord, doc_id, text)`` frame."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.ordering import ranked_rows
from ..functions.text import PY_NONSPACE, truthy

Reader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class SourceSpec:
    """One named source: how to read it, which field holds the text, and the
    column that fixes its stream order (Spark has no row order of its own)."""
    name: str
    reader: Reader
    text_key: str = "text"
    order_key: str = "doc_id"
    max_docs: int | None = None


def resolve_text(df: DataFrame, text_key: str) -> Column:
    """A2: the ``text_key`` value when truthy, else the first string field (in
    column order) longer than 20 characters, else null."""
    primary = F.col(text_key) if text_key in df.columns else F.lit(None).cast("string")
    fallbacks = [F.when(F.length(F.col(f.name)) > 20, F.col(f.name))
                 for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return F.coalesce(F.when(truthy(primary), primary), *fallbacks)


def keep_nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    """A3 filter: keep rows whose stripped text is non-empty; text stays unstripped."""
    return df.filter(F.col(text).rlike("(?U)" + PY_NONSPACE))


def cap_per_source(df: DataFrame, max_docs: int | None, part: Sequence[str] = ("source",),
                   order: str = "doc_id") -> DataFrame:
    """A3 cap: first ``max_docs`` rows of each source by ``order``; None/0 = no cap.

    Keys alone are ranked, in range-sized tasks; null sources count as one
    source, and rows that share a key are taken by the hash of their text.
    """
    if not max_docs:
        return df
    t = df.withColumn("__tie", F.xxhash64("text"))
    return ranked_rows(t, list(part), order, "__rank", max_docs, tie=["__tie"]).drop("__tie", "__rank")


def scan_source(spark: SparkSession, spec: SourceSpec, ord_: int) -> DataFrame:
    raw = spec.reader(spark)
    text = resolve_text(raw, spec.text_key)
    df = raw.select(F.lit(spec.name).alias("source"), F.lit(ord_).alias("ord"),
                    F.expr(spec.order_key).cast("bigint").alias("doc_id"),
                    text.alias("text"))
    df = keep_nonblank(df)
    return cap_per_source(df, spec.max_docs)


def scan_sources(spark: SparkSession, specs: Sequence[SourceSpec]) -> DataFrame:
    """A1: union of every source, registry position kept as ``ord``."""
    frames = [scan_source(spark, s, i) for i, s in enumerate(specs)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def corpus_by_column(df: DataFrame, source_col: str, registry: Sequence[str],
                     text_key: str = "text", order_key: str = "doc_id",
                     max_docs: int | None = None) -> DataFrame:
    """A1 for a table that already holds several sources in one column: a single
    scan (no per-source re-read); ``ord`` is the position in ``registry``, names
    not listed come last."""
    ords = F.when(F.col(source_col).isNull(), F.lit(len(registry)))
    for i, name in enumerate(registry):
        ords = ords.when(F.col(source_col) == name, F.lit(i))
    ords = ords.otherwise(F.lit(len(registry)))
    text = resolve_text(df, text_key)
    out = df.select(F.col(source_col).alias("source"), ords.alias("ord"),
                    F.col(order_key).cast("bigint").alias("doc_id"), text.alias("text"))
    out = keep_nonblank(out)
    return cap_per_source(out, max_docs)
