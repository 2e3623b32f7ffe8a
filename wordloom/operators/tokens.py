"""Token corpus: end-of-text, budget, head split, blocks, reports.

A document row carries either only its token count ``n`` (length-only plans)
or also its ``ids`` array; every operator here handles both, so a budget can be
planned on counts and the arrays sliced afterwards.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ordering import null_safe_join, prefix_sum
from ..functions.text import EOT_ID

VAL_FRAC = 0.005     # head share held out for validation (fixed value)
BLOCK = 4096         # tokens per stored block
PROGRESS_STEP = 5_000_000


def append_eot(df: DataFrame, ids: str = "ids", eot: int = EOT_ID) -> DataFrame:
    """Each document's ids followed by the end-of-text id."""
    return df.withColumn(ids, F.concat(F.col(ids), F.array(F.lit(eot))))


def with_length(df: DataFrame, ids: str = "ids", n: str = "n") -> DataFrame:
    return df.withColumn(n, F.size(F.col(ids)).cast("bigint"))


UNLIMITED = (1 << 63) - 1


def budget_of(budget: int | Mapping[str, int] | None, source: str = "source") -> Column:
    """One budget for all sources, one per source (others have none), or none."""
    if budget is None or isinstance(budget, int):
        return F.lit(UNLIMITED if budget is None else budget).cast("bigint")
    out = F.lit(UNLIMITED).cast("bigint")
    for name, b in budget.items():
        out = F.when(F.col(source) == name, F.lit(b).cast("bigint")).otherwise(out)
    return out


def budget_cut(df: DataFrame, budget: int | Mapping[str, int] | None, part: Sequence[str] = ("source",),
               order: str = "doc_id", n: str = "n", tie: Sequence[str] = ()) -> DataFrame:
    """Documents in order until the running total reaches the source's
    budget (the crossing document included), truncated to exactly as many.

    Adds ``off`` (tokens before the doc) and ``m`` (tokens kept). Ranges that
    start past the budget are dropped before the row-level window. Pass keys
    and counts only.
    """
    cum = prefix_sum(df, part, order, n, "off", stop_at=None if budget is None else budget_of(budget), tie=tie)
    left = budget_of(budget) - F.col("off")
    return cum.filter(left > 0).withColumn("m", F.least(F.col(n), left).cast("bigint"))


def progress_marks(df: DataFrame, budget: int, step: int = PROGRESS_STEP,
                   part: Sequence[str] = ("source",), order: str = "doc_id",
                   n: str = "n") -> DataFrame:
    """C4: documents after which the running total first passes a multiple of
    ``step`` (not the budget-crossing one, which ends the build)."""
    cum = prefix_sum(df, part, order, n, "off", stop_at=budget)
    total = F.col("off") + F.col(n)
    mark = (total < F.lit(budget)) & (F.floor(total / step) > F.floor(F.col("off") / step))
    return cum.filter(mark).select(*part, order, total.alias("total"))


def source_totals(kept: DataFrame, part: Sequence[str] = ("source",),
                  val_frac: float = VAL_FRAC) -> DataFrame:
    """Per source: tokens written and the head length held out for val."""
    return kept.groupBy(*part).agg(F.sum("m").cast("bigint").alias("total")).withColumn(
        "n_val", F.floor(F.col("total") * F.lit(val_frac)).cast("bigint"))


def head_split(kept: DataFrame, val_frac: float = VAL_FRAC,
               part: Sequence[str] = ("source",), ids: str | None = "ids",
               n_val: str | None = None) -> DataFrame:
    """The first ``floor(total * val_frac)`` tokens of each source are val,
    the rest train; a document may straddle the cut and yield two segments.

    Output: ``(*part, split, doc_id, pos, len[, ids])`` where ``pos`` is the
    segment's offset inside its split. The totals have one row per source.
    """
    part = list(part)
    if n_val:                                   # the caller knows the cut of each row
        j = kept.withColumn("n_val", F.col(n_val))
    else:
        j = null_safe_join(kept, source_totals(kept, part, val_frac).select(*part, "n_val"), part)
    off, m, nv = F.col("off"), F.col("m"), F.col("n_val")
    val_len = F.least(off + m, nv) - off
    train_start = F.greatest(off, nv)
    train_len = off + m - train_start
    segs = F.array(
        F.struct(F.lit("val").alias("split"), off.alias("pos"), val_len.alias("len"),
                 F.lit(0).cast("bigint").alias("skip")),
        F.struct(F.lit("train").alias("split"), (train_start - nv).alias("pos"),
                 train_len.alias("len"), (train_start - off).alias("skip")))
    has_ids = bool(ids) and ids in kept.columns
    cols = [*part, "doc_id"] + ([ids] if has_ids else [])
    ex = j.select(*cols, F.explode(F.filter(segs, lambda s: s["len"] > 0)).alias("s"))
    out = ex.select(*part, F.col("s.split").alias("split"), "doc_id",
                    F.col("s.pos").alias("pos"), F.col("s.len").alias("len"),
                    *([F.slice(F.col(ids), (F.col("s.skip") + 1).cast("int"),
                               F.col("s.len").cast("int")).alias(ids)] if has_ids else []))
    return out


def corpus_report(segments: DataFrame, part: Sequence[str] = ("source",)) -> DataFrame:
    """Tokens and segments per (source, split), source subtotals and the
    grand total (rollup rows have null keys)."""
    return segments.rollup(*part, "split").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("len").cast("bigint").alias("tokens"))


def guarded(blocks: DataFrame, vocab_size: int, toks: str = "toks") -> DataFrame:
    """C6 in the write itself: the first block with an id outside ``[0, vocab)`` or the uint16 range
    fails the job that writes it."""
    limit = min(vocab_size, 1 << 16)
    good = (F.array_min(toks) >= 0) & (F.array_max(toks) < limit)
    seen = F.concat(F.lit(f"id outside 0..{limit - 1} in block "), F.col("block_id").cast("string"))
    return blocks.withColumn(toks, F.when(F.coalesce(good, F.lit(True)), F.col(toks)).otherwise(
        F.raise_error(seen).cast(blocks.schema[toks].dataType)))


def watched(blocks: DataFrame, build: Observation, toks: str = "toks") -> DataFrame:
    """C4/C6 marks of a build, taken from its own write: ``build.get`` has the blocks, tokens, val
    tokens and the range of ids once the write is done, without another pass."""
    n = F.size(toks)
    return blocks.observe(
        build, F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("split") == "val", n)), F.lit(0)).cast("bigint").alias("val_tokens"),
        F.min(F.array_min(toks)).alias("min_id"), F.max(F.array_max(toks)).alias("max_id"))


def id_guard(df: DataFrame, vocab_size: int, ids: str = "ids",
             part: Sequence[str] = ("source",)) -> DataFrame:
    """Id range per source and the number of ids outside ``[0, vocab)`` or
    the uint16 range."""
    limit = min(vocab_size, 1 << 16)
    # the per-id count only runs for documents whose range is already out of bounds
    out_of_range = (F.array_min(ids) < 0) | (F.array_max(ids) >= limit)
    bad = F.when(out_of_range, F.size(F.filter(F.col(ids), lambda x: (x < 0) | (x >= limit))))\
        .otherwise(F.lit(0))
    return df.groupBy(*part).agg(
        F.min(F.array_min(ids)).alias("min_id"),
        F.max(F.array_max(ids)).alias("max_id"),
        F.sum(bad).cast("bigint").alias("violations"))


def to_blocks(segments: DataFrame, block: int = BLOCK, ids: str = "ids",
              part: Sequence[str] = ("source", "split"), buckets: int | None = None) -> DataFrame:
    """A5 layout: fixed-size blocks of the flat per-(source, split) token array.

    Each segment explodes only the block ids it touches (rows ~ docs + blocks,
    never tokens); the slices are then grouped by block and concatenated in
    position order. A block gathers at most ``block`` slices. ``buckets`` fixes the number
    of partitions by block, for a bucketed write.
    """
    part = list(part)
    pos, ln = F.col("pos"), F.col("len")
    first, last = F.floor(pos / block), F.floor((pos + ln - 1) / block)
    ex = segments.select(*part, "pos", "len", ids,
                         F.explode(F.sequence(first, last)).alias("block_id"))
    lo = F.greatest(F.col("block_id") * block, pos)
    hi = F.least((F.col("block_id") + 1) * block, pos + ln)
    piece = F.slice(F.col(ids), (lo - pos + 1).cast("int"), (hi - lo).cast("int"))
    sl = ex.select(*part, "block_id", lo.alias("start"), piece.alias("toks"))
    sl = sl.repartition(buckets, *part, "block_id") if buckets else sl
    grouped = sl.groupBy(*part, "block_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "toks"))).alias("__p"))
    return grouped.select(*part, F.col("block_id").cast("bigint").alias("block_id"),
                          F.flatten(F.col("__p.toks")).cast("array<int>").alias("toks"))
