"""Raw text -> token corpus: the build the reference runs per source.

documents -> non-blank -> encode -> EOT -> budget -> head split -> blocks/report
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ordering import null_safe_join
from ..operators.bpe import BpeModel
from ..operators.tokenizer import encode
from ..operators.tokens import (VAL_FRAC, append_eot, budget_cut, budget_of, head_split, source_totals,
                                with_length)
from ..session import stored

Budget = int | Mapping[str, int] | None


def byte_lengths(corpus: DataFrame) -> DataFrame:
    """Token counts at byte level (no merges): UTF-8 bytes + the EOT id."""
    return corpus.select("source", "ord", "doc_id",
                         (F.octet_length("text") + 1).cast("bigint").alias("n"))


def length_segments(corpus: DataFrame, budget: Budget, val_frac: float = VAL_FRAC) -> DataFrame:
    """Phase-0 plan on counts only: which part of each doc lands in which split."""
    return head_split(budget_cut(byte_lengths(corpus), budget), val_frac, ids=None)


def split_lengths(corpus: DataFrame, budget: Budget = None, val_frac: float = VAL_FRAC) -> DataFrame:
    """Tokens per (source, split) at byte level: a source keeps the lesser of its tokens and its
    budget, and its head is ``floor(kept * val_frac)``, so one sum per source tells both."""
    t = byte_lengths(corpus).groupBy("source").agg(F.sum("n").alias("n"))
    t = t.select("source", F.least("n", budget_of(budget)).cast("bigint").alias("kept"))
    val = F.floor(F.col("kept") * F.lit(val_frac)).cast("bigint")
    both = F.array(F.struct(F.lit("val").alias("split"), val.alias("n")),
                   F.struct(F.lit("train").alias("split"), (F.col("kept") - val).alias("n")))
    return t.select("source", F.inline(both)).filter("n > 0")


def encoded_documents(corpus: DataFrame, model: BpeModel | None) -> DataFrame:
    """``(source, ord, doc_id, rid, n, ids)``, encoded once and stored (a few bits an id); ``rid``
    tells rows apart whose ids repeat."""
    enc = with_length(append_eot(encode(corpus, model, ["source", "ord", "doc_id"])))
    return stored(enc.withColumn("rid", F.monotonically_increasing_id()), "encoded")


def token_documents(corpus: DataFrame, model: BpeModel | None, budget: Budget) -> DataFrame:
    """C1 + C2 on real ids: ``(source, ord, doc_id, off, m, ids)`` for kept docs.
    Only keys and counts go through the running sum."""
    enc = encoded_documents(corpus, model)
    kept = budget_cut(enc.select("source", "doc_id", "rid", "n"), budget, tie=["rid"])
    rows = enc.select("ord", "rid", "ids").join(kept, "rid")
    return rows.select("source", "ord", "doc_id", "off", "m",
                       F.slice("ids", 1, F.col("m").cast("int")).alias("ids"))


def token_segments(corpus: DataFrame, model: BpeModel | None, budget: Budget,
                   val_frac: float = VAL_FRAC, short: bool = False) -> DataFrame:
    """C3 on real ids: ``(source, split, doc_id, pos, len, ids)``. The split is
    found on counts; the encoded rows meet it once. ``short``: ids as 16-bit numbers where the
    vocabulary allows, for the shuffles on the way to blocks."""
    enc = encoded_documents(corpus, model)
    if short and (model or BpeModel()).vocab_size <= 1 << 15:
        enc = enc.withColumn("ids", F.col("ids").cast("array<smallint>"))
    kept = budget_cut(enc.select("source", "doc_id", "rid", "n"), budget, tie=["rid"])
    totals = source_totals(kept, val_frac=val_frac).select("source", "n_val")
    cut = null_safe_join(kept, totals, ["source"]).select("rid", "off", "m", "n_val")
    rows = enc.select("source", "doc_id", "rid", "ids").join(cut, "rid")
    return head_split(rows, val_frac, n_val="n_val")


def stored_blocks(corpus: DataFrame, model: BpeModel | None, budget: Budget = None, path: str | None = None,
                  val_frac: float = VAL_FRAC, build: Observation | None = None, buckets: int | None = None) -> DataFrame:
    """A5 for loaders: the block table, bucketed by block (see ``store_buckets``). ``build`` gets the
    counts and the id range of the write; an id out of range fails it."""
    from ..sources.files import scratch_path, store_buckets
    path = path or scratch_path(corpus.sparkSession, "blocks")
    vocab = (model or BpeModel()).vocab_size
    return store_buckets(token_segments(corpus, model, budget, val_frac, short=True), path, buckets, vocab, build)
