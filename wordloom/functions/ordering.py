"""Order-dependent building blocks that never funnel a whole table into one task.

* ``hashed_uniform`` - a uniform draw keyed by row identity, so results do not
  depend on partitioning (``rand(seed)`` does).
* ``prefix_sum`` - the ordered running sum: keys are dealt into equi-depth ranges
  of their order, the ranges' totals are summed, then the rows inside each range.
  Dense, sparse, hashed, repeated and null keys all give ranges of about one size.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

DRAW_HEX = 13                # 52 bits: every start of a source of 2^52 tokens can be drawn


def hashed_uniform(*parts) -> Column:
    """U[0,1) from the first 52 bits of md5 over ``p1:p2:...``."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                             for p in parts])
    return F.conv(F.substring(F.md5(key), 1, DRAW_HEX), 16, 10).cast("bigint") / F.lit(float(1 << 4 * DRAW_HEX))


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``cols`` where null equals null; the columns come from the left."""
    named = right.select(*[F.col(c).alias(f"__j_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__j_{c}"))
    return left.join(named, cond, how).drop(*[f"__j_{c}" for c in cols])


def _ranges(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in equi-depth ranges of ``(part, order)``, numbered in that order as ``__range`` and
    stored. The input is evaluated once, into a stored table of its own, as Spark samples what
    it ranges; rows that agree in everything are told apart by their place in that table, so
    no key, null or other, is too large for a range."""
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "order-keys")
    return stored(rows.repartitionByRange(*part, *order, "__row").withColumn("__range", F.spark_partition_id()), "order-ranges")


def prefix_sum(df: DataFrame, part: Sequence[str], order: str, value: str,
               out: str = "off", stop_at: Column | int | None = None,
               tie: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same ``part``, ordered by the key
    ``order`` (exclusive running sum; null keys first, null parts are a part of their own).
    Rows of one key are ordered by ``tie``, then by ``value``.

    Two shuffles whatever the keys look like: one by equi-depth ranges of the order, one by
    range for the sums inside it. Between them stand the totals, one row per range and part.
    ``stop_at`` (a literal or a column of ``df`` constant per part) drops ranges whose start is
    past it before the rows are summed; rows of kept ranges are returned unfiltered. Pass keys
    and counts only.
    """
    part = list(part)
    stop = None if stop_at is None else stop_at if isinstance(stop_at, Column) else F.lit(stop_at)
    inside = [order, *tie, value]
    ranged = _ranges(df, part, inside)
    totals = ranged.groupBy(*part, "__range").agg(
        F.sum(value).alias("__t"), *([F.max(stop).alias("__stop")] if stop is not None else []))
    before = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)   # a row per range
    starts = totals.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    if stop is not None:
        starts = starts.filter(F.col("__o") < F.col("__stop"))
    rows = null_safe_join(ranged, starts.select(*part, "__range", "__o"), [*part, "__range"])
    here = Window.partitionBy(*part, "__range").orderBy(*inside, "__row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.col("__o") + F.sum(value).over(here) - F.col(value)).drop("__range", "__row", "__o")


def ranked_keys(df: DataFrame, part: Sequence[str], order: Sequence[str], limit: Column | int | None = None) -> DataFrame:
    """``(*part, *order, n, off)``: rows of each key and rows before it; repeated keys are one
    row here, so ranks can meet the rows without multiplying them."""
    keys = df.groupBy(*part, *order).agg(F.count(F.lit(1)).alias("__n"))
    return prefix_sum(keys, part, order[0], "__n", "__off", stop_at=limit, tie=order[1:])


def ranked_rows(df: DataFrame, part: Sequence[str], order: str, out: str, limit: Column | int | None = None,
                tie: Sequence[str] = ()) -> DataFrame:
    """Rows with their 0-based rank ``out`` inside ``part`` by ``order``, then ``tie``; with
    ``limit`` (a number, or a column constant per part) only the first so many. Only keys
    are ranked; the rows meet them in one join, and rows that agree in key and tie are
    numbered among themselves."""
    by = [order, *tie]
    keys = ranked_keys(df, part, by, limit)
    cap = None if limit is None else limit if isinstance(limit, Column) else F.lit(limit)
    if cap is not None:
        keys = keys.filter(F.col("__off") < cap)
    rows = null_safe_join(df, keys, [*part, *by])
    rows = rows.withColumn(out, F.col("__off") + F.row_number().over(Window.partitionBy(*part, *by).orderBy(F.lit(0))) - 1)
    if cap is not None:
        rows = rows.filter(F.col(out) < cap)
    return rows.drop("__n", "__off")


def hash_key(*parts) -> Column:
    """Deterministic shuffle key: md5 hex of ``p1:p2:...``."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                    for p in parts]))


def rank_by_hash(df: DataFrame, key: str, part: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based rank by a hash key (E6/E10 shuffles), equal keys in any order."""
    rows = df.withColumn("__one", F.lit(1).cast("bigint"))
    return prefix_sum(rows, part, key, "__one", out).drop("__one")
