"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a word target; what it contributes is decided by one hash threshold per
source. Sizes are summed by (source, hash bucket); the running sum over the buckets finds
the bucket in which the budget ends, and only that bucket is split again by the next hash
digits, until one hash value is left. Documents are then kept by comparing their hash with
the threshold: no row is ever sorted, and thresholds of growing budgets are nested.

Defined cases: a null text has size 0; a null source is a source of its own and comes last;
null and repeated doc_ids are allowed (rows with one hash share what is left, by size); an
empty table gives an empty result; further columns pass through untouched. Columns that
carry one of the result's names are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)          # by rank of the source, repeating
MAX_EPOCHS = 3               # a document is repeated at most this often
SEED = "mix"
HASH_HEX = 15                # 60 hash bits of md5
LEVEL_HEX = 3                # 4,096 buckets a level


def n_words(text: Column) -> Column:
    """How many words a text has: each is cut to one mark and the marks are counted, so no list
    of words is built."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), GAP, "")).cast("long")


def doc_hash(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of md5 over the doc_id's text, as fixed-width hex (null: 'null')."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"),
                                                                    F.lit("null")))), 1, HASH_HEX)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, stopped at ``max_epochs`` times
    the source's size, the excess reshared by weight. The share per unit of weight is found
    in one ordered pass over the sources (a row per source, after the sums)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("__w", w.cast("double"))
    per = per.withColumn("__cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy((F.col("__cap") / F.col("__w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # share per weight if every source before this one is stopped at its cap
    level = (total - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(rest)
    per = per.withColumn("__level", level)
    ratio = F.col("__cap") / F.col("__w")
    first_fit = F.min(F.when(F.col("__level") <= ratio,
                             F.struct(ratio.alias("ratio"), F.col("__level").alias("level"))))
    per = per.withColumn("__unit", first_fit.over(Window.partitionBy()))
    unit = F.col("__unit.level")
    target = F.least(F.col("__cap").cast("double"),
                     F.coalesce(F.col("__w") * unit, F.col("__cap").cast("double")))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source ``(full, part, hash, tied)``: whole repeats, words left for the partial
    repeat, the hash at which they run out and the size of the rows with that hash (null
    where nothing is left to take). ``sizes`` is ``(source, size, u)``."""
    full = F.when(F.col("source_size") > 0,
                  F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.select(
        F.col("source").alias("__s"), full.cast("long").alias("full"),
        F.when(F.col("source_size") > 0,
               F.round(F.col("target") - full * F.col("source_size"))).otherwise(0)
        .cast("long").alias("left"), F.lit("").alias("prefix"))
    for at in range(0, HASH_HEX, LEVEL_HEX):
        in_bucket = sizes.join(
            state.filter(F.col("left") > 0),
            F.col("source").eqNullSafe(F.col("__s"))
            & (F.substring("u", 1, at) == F.col("prefix") if at else F.lit(True)), "inner")
        hist = (in_bucket.groupBy("__s", F.substring("u", 1, at + LEVEL_HEX).alias("__b"))
                .agg(F.sum("size").alias("__n"), F.first("left").alias("left")))
        up_to = F.sum("__n").over(Window.partitionBy("__s").orderBy("__b"))
        hist = (hist.withColumn("__up", up_to)
                .filter((F.col("__up") >= F.col("left")) & (F.col("__up") - F.col("__n") < F.col("left"))))
        hit = hist.select(F.col("__s").alias("__h"), F.col("__b").alias("__p"),
                          (F.col("left") - F.col("__up") + F.col("__n")).alias("__l"), "__n")
        # a row per source, written out: each level's plan stays as small as the first
        state = materialize(state.join(hit, F.col("__s").eqNullSafe(F.col("__h")), "left").select(
            "__s", "full", F.coalesce("__l", "left").alias("left"),
            F.coalesce("__p", "prefix").alias("prefix"), F.col("__n").alias("tied")), "mix-level")
    return state.select(F.col("__s"), "full", F.col("left").alias("part"),
                        F.col("prefix").alias("hash"), "tied")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``: ``taken`` counts the words the mix
    takes from the row, repeats included; the row at the threshold gives its first words only,
    so every source meets its target to the word."""
    docs = docs.drop("size", "source_size", "target", "taken")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumn("size", n_words(text))
    slim = materialize(sized.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                    "size", doc_hash(F.col(id_col), seed).alias("u")), "mix-sizes")
    plan = mix_plan(slim, weights, max_epochs)
    u = doc_hash(F.col(id_col), seed)
    out = sized.join(plan, F.col(source_col).eqNullSafe(F.col("__s")), "left")
    return out.withColumn("taken", taken_words(F.col("size"), u)).drop(*PLAN_COLUMNS)


PLAN_COLUMNS = ("__s", "full", "part", "hash", "tied")


def mix_plan(slim: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source, written out: sizes, target and threshold."""
    targets = materialize(source_targets(slim, weights, max_epochs), "mix-targets")
    found = thresholds(slim, targets)
    return materialize(
        targets.join(found, F.col("source").eqNullSafe(F.col("__s")), "inner").drop("source"), "mix-plan")


def taken_words(size: Column, u: Column) -> Column:
    extra = (F.when(F.col("hash") == "", F.lit(0))
             .when(u < F.col("hash"), size)
             .when(u == F.col("hash"), F.floor(F.col("part") * size / F.col("tied")))
             .otherwise(F.lit(0)))
    return (F.col("full") * size + F.coalesce(extra, F.lit(0))).cast("long")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: tuple = WEIGHTS,
                max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix as ``(doc_id, size, source_size, target, taken)``: texts are read once, only
    their sizes go further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        n_words(text).alias("size"),
        doc_hash(F.col(id_col), seed).alias("u")), "mix-sizes")
    plan = mix_plan(slim, weights, max_epochs)
    out = slim.join(plan, F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      taken_words(F.col("size"), F.col("u")).alias("taken"))
