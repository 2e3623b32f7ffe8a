"""Training-run metrics (G1-G8): the log a trainer appends, analysed as tables.

A log row is ``(run, ingest_seq, step, train_loss, lr, val_avg, val_<source>..., ts)``.
Groups here are per run or per (run, step): a run has one row per evaluation,
so no group grows with the corpus; de-duplication is an aggregate (partial
aggregation first), not a window over repeats.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import r6


def series_columns(df: DataFrame) -> list[str]:
    """Every ``val_*`` column plus ``train_loss`` (all columns, not the first row's)."""
    return [c for c in df.columns if c.startswith("val_")] + \
        (["train_loss"] if "train_loss" in df.columns else [])


def dedup_resumed(log: DataFrame, keys: tuple[str, ...] = ("run", "step"),
                  seq: str = "ingest_seq") -> DataFrame:
    """A step repeated after a resume keeps its *last* logged row."""
    cols = [c for c in log.columns if c not in keys]
    latest = F.max_by(F.struct(*cols), F.col(seq))
    return log.groupBy(*keys).agg(latest.alias("__r")).select(*keys, "__r.*")


def curves(log: DataFrame) -> DataFrame:
    """G1: long form ``(run, step, series, value)``, nulls dropped."""
    series = series_columns(log)
    long = log.unpivot(["run", "step"], series, "series", "value")
    return long.filter(F.col("value").isNotNull())


def running_best(log: DataFrame) -> DataFrame:
    """``best_before`` = min of earlier ``val_avg`` in the run; a row is a
    new best only when strictly below it (the first evaluation always is)."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.min("val_avg").over(w)
    return log.select("run", "step", "val_avg", prev.alias("best_before"),
                      (prev.isNull() | (F.col("val_avg") < prev)).alias("is_best"))


def latest_state(log: DataFrame) -> DataFrame:
    """The resume point of each run: its last evaluated step, with the best
    ``val_avg`` seen up to it."""
    return log.groupBy("run").agg(
        F.max("step").alias("step"),
        F.max_by("val_avg", "step").alias("val_avg"),
        F.max_by("train_loss", "step").alias("train_loss"),
        F.min("val_avg").alias("best_val"))


def throughput(log: DataFrame, tokens_per_step: int) -> DataFrame:
    """Tokens per second between consecutive evaluations of a run."""
    w = Window.partitionBy("run").orderBy("step")
    us = F.unix_micros(F.col("ts").cast("timestamp"))  # NTZ read as session-zone (UTC) time
    dt = (us - F.lag(us).over(w)) / F.lit(1e6)
    ds = F.col("step") - F.lag("step").over(w)
    t = log.select("run", "step", (ds * F.lit(tokens_per_step)).alias("tokens"), dt.alias("secs"))
    return t.filter(F.col("secs").isNotNull()).select(
        "run", "step", F.col("tokens").cast("bigint").alias("tokens"), r6(F.col("secs")).alias("secs"),
        r6(F.try_divide(F.col("tokens"), F.col("secs"))).alias("tokens_per_sec"))


@dataclass(frozen=True)
class Schedule:
    """Linear warm-up, cosine decay to ``min_lr``, flat after ``max_steps``."""
    lr: float
    min_lr: float
    warmup_steps: int
    max_steps: int

    def at(self, step) -> Column:
        """The share ``p`` of the decay done is held to 0..1, so the flat tail is its end:
        ``cos(pi p / 2)`` squared falls from 1 to 0."""
        s = step if isinstance(step, Column) else F.lit(step)
        share = (s - self.warmup_steps) / F.lit(float(max(1, self.max_steps - self.warmup_steps)))
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
        fall = F.pow(F.cos(p * (math.pi / 2)), 2) * (self.lr - self.min_lr) + self.min_lr
        return F.when(s < self.warmup_steps, (s + 1) * (self.lr / max(1, self.warmup_steps))).otherwise(fall)


def sft_lr(step, total: int, lr: float) -> Column:
    """Instruction-tuning schedule: cosine from ``lr`` to 0 over ``total`` steps."""
    s = step if isinstance(step, Column) else F.lit(step)
    return F.lit(lr) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * s / F.lit(total)))


def lr_audit(log: DataFrame, sched: Schedule, rel_tol: float = 1e-9) -> DataFrame:
    """Rows whose logged ``lr`` differs from the schedule. The value logged
    at step ``s`` is the schedule at ``s - 1`` (the step counter moves first)."""
    exp = sched.at(F.col("step") - 1)
    err = F.abs(F.col("lr") - exp) / F.greatest(F.abs(exp), F.lit(1e-30))
    return log.select("run", "step", "ingest_seq", "lr", exp.alias("expected"), err.alias("rel_err")) \
        .filter(F.col("rel_err") > rel_tol)


def run_comparison(log: DataFrame) -> DataFrame:
    """Best (lowest) value of each validation series per run, ranked
    across runs (rank 1 = best run for that series)."""
    long = curves(log).filter(F.col("series").startswith("val_"))
    best = long.groupBy("run", "series").agg(F.min("value").alias("best"))
    w = Window.partitionBy("series").orderBy("best")  # one row per run
    return best.withColumn("rank", F.rank().over(w))


def start_end_report(log: DataFrame) -> DataFrame:
    """First and last value of each series per run, and the gap of the
    last train loss over each last validation value."""
    long = curves(log)
    se = long.groupBy("run", "series").agg(
        F.min_by("value", "step").alias("first_value"),
        F.max_by("value", "step").alias("last_value"))
    last_train = se.filter(F.col("series") == "train_loss") \
        .select("run", F.col("last_value").alias("__lt"))
    j = se.join(last_train, "run", "left")
    gap = F.when(F.col("series").startswith("val_"), F.col("__lt") - F.col("last_value"))
    return j.select("run", "series", "first_value", "last_value", gap.alias("gap"))
