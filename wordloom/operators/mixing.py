"""Weighted mixing loader (D1-D11): windows drawn from the stored token blocks.

The mix is a parameter-sized table (one row per mix entry), so it is the only
thing broadcast without a runtime check. Window draws are keyed hashes of
``(seed, split, i)``, independent of partitioning; reading a window is an
equi-join on block id, never a range join against the corpus.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import hashed_uniform
from ..functions.text import ids_string, r6
from .tokens import BLOCK

VAL_SEED_SHIFT = 99           # D8: val draws use seed + 99 (fixed value)


def split_lengths(blocks: DataFrame) -> DataFrame:
    """Tokens stored per (source, split)."""
    return blocks.groupBy("source", "split").agg(F.sum(F.size("toks")).cast("bigint").alias("n"))


def mix_frame(spark: SparkSession, mix: Mapping[str, float]) -> DataFrame:
    """The mix as rows, insertion order kept as ``ord``."""
    rows = [(name, i, float(w)) for i, (name, w) in enumerate(mix.items())]
    return spark.createDataFrame(rows, "source string, ord int, weight double")


def resolve_mix(mix: DataFrame, lengths: DataFrame, split: str, seq_len: int) -> DataFrame:
    """D1 + D2: per mix entry, the split actually read and whether it is usable.

    Prefers ``split``; falls back to ``train`` when that is absent or empty
    (``fell_back``); drops entries with no data or ``n <= seq_len + 1``.
    """
    req = lengths.filter(F.col("split") == split).select("source", F.col("n").alias("n_req"))
    trn = lengths.filter(F.col("split") == "train").select("source", F.col("n").alias("n_train"))
    j = mix.join(req, "source", "left").join(trn, "source", "left")
    has_req = F.coalesce(F.col("n_req"), F.lit(0)) > 0
    has_trn = F.coalesce(F.col("n_train"), F.lit(0)) > 0
    chosen = F.when(has_req, F.lit(split)).when(has_trn, F.lit("train"))
    n = F.when(has_req, F.col("n_req")).when(has_trn, F.col("n_train")).otherwise(F.lit(0))
    out = j.select("source", "ord", "weight", chosen.alias("read_split"),
                   n.cast("bigint").alias("n"),
                   (~has_req & has_trn & F.lit(split != "train")).alias("fell_back"))
    reason = (F.when(F.col("read_split").isNull(), F.lit("no data"))
              .when(F.col("n") <= seq_len + 1, F.lit("too short")))
    return out.withColumn("drop_reason", reason)


def mix_bounds(resolved: DataFrame) -> DataFrame:
    """D3: weights of surviving entries normalised to sum 1, with cumulative
    ``[lo, hi)`` bounds in mix order; the last ``hi`` is exactly 1."""
    live = resolved.filter(F.col("drop_reason").isNull())
    w_all = Window.partitionBy()  # bounded: one row per mix entry
    w_cum = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    w_last = Window.orderBy(F.desc("ord"))
    t = live.withColumn("p", F.col("weight") / F.sum("weight").over(w_all))
    t = t.withColumn("hi", F.sum("p").over(w_cum))
    t = t.withColumn("hi", F.when(F.row_number().over(w_last) == 1, F.lit(1.0))
                     .otherwise(F.col("hi")))
    # the previous bound itself, not hi - p: no draw falls into a gap or on two entries
    return t.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("ord")))


def resolved_bounds(spark: SparkSession, lengths: DataFrame, mix: Mapping[str, float],
                    split: str, seq_len: int) -> DataFrame:
    """D1-D3 evaluated once: the bounds table has at most one row per mix entry,
    so it is collected and re-served as a literal frame (no corpus recompute in
    every later use). Raises when no entry is usable, as the reference does."""
    rows = mix_bounds(resolve_mix(mix_frame(spark, mix), lengths, split, seq_len)) \
        .select("source", "ord", "read_split", "n", "p", "lo", "hi").collect()
    if not rows:
        raise RuntimeError(f"no usable sources for split={split}, mix={dict(mix)}")
    return spark.createDataFrame(
        rows, "source string, ord int, read_split string, n bigint, p double, lo double, hi double")


def draw_windows(spark: SparkSession, bounds: DataFrame, n_seq: int, seq_len: int,
                 batch_size: int, seed: int, split: str, tag: str = "") -> DataFrame:
    """D4 + D5 + D7 + D8: ``n_seq`` draws: source by weight, then a start in
    ``[0, n - seq_len - 1)``; sequence ``i`` goes to batch ``i div batch_size``."""
    s = seed + (0 if split == "train" else VAL_SEED_SHIFT)
    base = [F.lit(s), F.lit(split)] + ([F.lit(tag)] if tag else [])
    draws = spark.range(n_seq).withColumnRenamed("id", "i").select(
        "i", hashed_uniform(*base, F.col("i"), F.lit("src")).alias("u"),
        hashed_uniform(*base, F.col("i"), F.lit("start")).alias("u2"))
    b = F.broadcast(bounds.select("source", "read_split", "n", "lo", "hi"))
    j = draws.join(b, (draws.u >= b.lo) & (draws.u < b.hi), "inner")
    start = F.floor(F.col("u2") * (F.col("n") - seq_len - 1)).cast("bigint")
    return j.select("i", (F.col("i") / batch_size).cast("bigint").alias("batch_id"),
                    (F.col("i") % batch_size).cast("int").alias("seq_in_batch"),
                    "source", F.col("read_split").alias("split"), start.alias("start"))


def read_windows(windows: DataFrame, blocks: DataFrame, seq_len: int, block: int = BLOCK) -> DataFrame:
    """``seq_len + 1`` contiguous tokens per draw; ``x`` drops the last,
    ``y`` the first.

    Each window explodes only the block ids it touches and meets the blocks on
    ``(source, split, block_id)``. Blocks stored in buckets of these keys are not
    moved: the windows are shuffled to them, or broadcast if their size allows.
    Blocks are sliced to the overlap *before* regrouping, so
    the regroup moves ``seq_len`` tokens per window, not whole blocks.
    """
    keys = windows.columns  # every draw column is carried through the regroup
    span = seq_len + 1
    st = F.col("start")
    wb = windows.select(*keys,
                        F.explode(F.sequence(F.floor(st / block),
                                             F.floor((st + span - 1) / block))).alias("block_id"))
    j = wb.join(blocks.select("source", "split", "block_id", "toks"),
                  ["source", "split", "block_id"])
    lo = F.greatest(F.col("block_id") * block, st)
    hi = F.least((F.col("block_id") + 1) * block, st + span)
    piece = F.slice("toks", (lo - F.col("block_id") * block + 1).cast("int"), (hi - lo).cast("int"))
    parts = j.select(*keys, lo.alias("lo"), piece.alias("piece"))
    g = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "piece"))).alias("__p"))
    flat = F.flatten(F.col("__p.piece"))
    w = g.select(*keys, flat.alias("__w"))
    return w.select(*keys, F.slice("__w", 1, seq_len).alias("x"),
                    F.slice("__w", 2, seq_len).alias("y"))


def mixed_batches(spark: SparkSession, blocks: DataFrame, mix: Mapping[str, float],
                  seq_len: int, batch_size: int, n_batches: int, seed: int = 1337,
                  split: str = "train", block: int = BLOCK, lengths: DataFrame | None = None) -> DataFrame:
    """D1-D8 end to end: ``(batch_id, seq_in_batch, source, split, start, x, y)``.
    ``lengths`` (tokens per source and split), if known, saves counting the blocks."""
    bounds = resolved_bounds(spark, split_lengths(blocks) if lengths is None else lengths, mix, split, seq_len)
    n_seq = n_batches * batch_size
    draws = draw_windows(spark, bounds, n_seq, seq_len, batch_size, seed, split)
    return read_windows(draws, blocks, seq_len, block).drop("i")


def batch_audit(windows: DataFrame, seq_len: int, vocab_size: int) -> DataFrame:
    """One pass of shape, shift and id-range checks over drawn windows."""
    x, y = F.col("x"), F.col("y")
    shift_ok = F.slice(x, 2, seq_len - 1) == F.slice(y, 1, seq_len - 1)
    in_range = (F.array_min(x) >= 0) & (F.array_max(x) < vocab_size) & \
               (F.array_min(y) >= 0) & (F.array_max(y) < vocab_size)
    return windows.agg(
        F.count(F.lit(1)).alias("windows"),
        F.countDistinct("batch_id").alias("batches"),
        F.sum(F.when((F.size(x) != seq_len) | (F.size(y) != seq_len), 1).otherwise(0))
         .cast("bigint").alias("bad_shape"),
        F.sum(F.when(shift_ok, 0).otherwise(1)).cast("bigint").alias("bad_shift"),
        F.sum(F.when(in_range, 0).otherwise(1)).cast("bigint").alias("bad_range"))


def realised_mix(draws: DataFrame, bounds: DataFrame) -> DataFrame:
    """D10 companion: share of drawn sequences per source next to its
    normalised weight (expected share)."""
    w = Window.partitionBy()  # one row per source
    got = (draws.groupBy("source").agg(F.count(F.lit(1)).alias("seqs"))
           .withColumn("share", r6(F.col("seqs") / F.sum("seqs").over(w))))
    return got.join(F.broadcast(bounds.select("source", r6(F.col("p")).alias("weight"))), "source", "right") \
        .select("source", F.coalesce("seqs", F.lit(0)).cast("bigint").alias("seqs"),
                F.coalesce("share", F.lit(0.0)).alias("share"), "weight")


def windows_as_strings(w: DataFrame) -> DataFrame:
    return w.select("batch_id", "seq_in_batch", "source", "split", "start",
                    ids_string(F.col("x")).alias("x"), ids_string(F.col("y")).alias("y"))


def val_windows(spark: SparkSession, blocks: DataFrame, sources: list[str], seq_len: int,
                batch_size: int, n_batches: int, eval_rounds: int, seed: int = 1337,
                block: int = BLOCK, lengths: DataFrame | None = None) -> DataFrame:
    """One single-source val loader per mix entry, ``eval_rounds`` times.

    All loaders and rounds are one draw over ``range(loaders * rounds * n)``;
    round ``r`` draws fresh windows because its hash key carries ``r`` (the
    reference's generator is not reset between evaluations). Entries without
    usable data are dropped (see ``resolve_mix`` for the reason).
    """
    lengths = split_lengths(blocks) if lengths is None else lengths
    mix = spark.createDataFrame([(s, k, 1.0) for k, s in enumerate(sources)],
                                "source string, ord int, weight double")
    live = resolve_mix(mix, lengths, "val", seq_len).filter(F.col("drop_reason").isNull())
    n_seq = n_batches * batch_size
    per_loader = eval_rounds * n_seq
    s = seed + VAL_SEED_SHIFT
    d = spark.range(len(sources) * per_loader).select(
        (F.col("id") / per_loader).cast("int").alias("ord"),
        ((F.col("id") / n_seq).cast("bigint") % eval_rounds).cast("int").alias("eval_round"),
        (F.col("id") % n_seq).alias("i"))
    j = d.join(F.broadcast(live.select("source", "ord", "read_split", "n")), "ord")
    u2 = hashed_uniform(F.lit(s), F.lit("val"), F.col("source"), F.col("eval_round"),
                        F.col("i"), F.lit("start"))
    draws = j.select(F.col("source").alias("loader"), "eval_round", "i",
                     (F.col("i") / batch_size).cast("bigint").alias("batch_id"),
                     (F.col("i") % batch_size).cast("int").alias("seq_in_batch"),
                     "source", F.col("read_split").alias("split"),
                     F.floor(u2 * (F.col("n") - seq_len - 1)).cast("bigint").alias("start"))
    return read_windows(draws, blocks, seq_len, block).drop("i")


def run_plan(presets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tokens per optimiser step, tokens seen, and epochs over the stored
    train corpus, per run preset. ``presets`` holds one row per preset."""
    corpus = lengths.filter(F.col("split") == "train").agg(
        F.sum("n").cast("bigint").alias("corpus_tokens")).scalar()  # scalar subquery
    tps = (F.col("batch_size") * F.col("grad_accum") * F.col("seq_len")).cast("bigint")
    j = presets.select("preset", tps.alias("tokens_per_step"),
                       (tps * F.col("max_steps")).cast("bigint").alias("total_tokens"),
                       corpus.alias("corpus_tokens"))
    return j.select("preset", "tokens_per_step", "total_tokens", "corpus_tokens",
                    r6(F.col("total_tokens") / F.col("corpus_tokens")).alias("epochs"))
