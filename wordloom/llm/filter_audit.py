"""Filter interaction audit: what every order of a set of filters removes, from one pass.

Each row gets a mask of the filters it fails. A state of the subset lattice is the set of
filters applied so far; the rows alive in a state are those whose mask misses it, so one
count per (part, mask) gives every state, and an edge (state, next filter) removes the
difference of two states. Path counts over the lattice, forward from the empty set and
backward from the full one, say how many orders walk along an edge: they weigh its removals
for the Shapley sums, and the steps of every single order are read from the same edges.

Rows are reduced to counts before anything is spread over orders: the work after the scan
grows with parts x 2^filters, not with rows x orders. The copy filter never gathers a group
of equal texts: the smallest id of a text is a partial aggregate, and the rows that hold it
meet it on (text digest, id).

Defined cases: a null text is the empty text; a null source is the part ''; a null id is
never larger than another id, so such a row is no copy; rows of one id and one text are no
copies of each other; a label counts if any label row of the id has it; an empty table gives
an empty report; further columns, whatever their names, are not read; long texts are read
whole.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

MAX_FILTERS = 7            # 7! = 5,040 orders of 7 steps for each part

# The five filters (fixed values): what parts words, thresholds of A to C, the characters of D.
GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
ODD_CHARACTERS = "[#$%&*|]"
FILTERS = "ABCDE"
COPY = FILTERS.index("E")


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty set, and that leave it to the full set:
    sums over the lattice's edges, forward and backward."""
    reach, leave = [0] * (1 << k), [0] * (1 << k)
    reach[0] = leave[-1] = 1
    for state in range(1 << k):
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(1 << k)):
        for f in range(k):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def text_failures(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D of one text (not null) and its words."""
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
            100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(ODD_CHARACTERS)]


def mask_of(failures: Sequence[Column]) -> Column:
    out = F.lit(0)
    for f, failed in enumerate(failures):
        out = out + failed.cast("int") * (1 << f)
    return out


def audit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, part, sha, mask, good, toxic)`` per document, written once; ``mask`` lacks the copy
    filter. Null ids get keys of their own by digest, so they meet no label and no single task."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(text, GAP), ""))
    rows = rows.select("id", "part", F.sha2(text, 256).alias("sha"), mask_of(text_failures(text, F.col("words"))).alias("mask"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.substring("sha", 1, 4))))
    flags = (labels.filter("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("string").alias("key"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    rows = rows.join(flags, "key", "left").select("id", "part", "sha", "mask", F.coalesce("good", F.lit(0)).alias("good"),
                                                  F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return materialize(rows, "filter-audit")


def mask_counts(rows: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)`` with the copy filter in the mask: all rows are counted
    as copies, and those that hold a text's smallest id are moved out again."""
    def counted(df: DataFrame, sign: int, bit: int) -> DataFrame:
        return df.groupBy("part", F.col("mask").bitwiseOR(F.lit(bit)).alias("mask")).agg(
            (F.count("*") * sign).alias("n"), (F.sum("good") * sign).alias("good"), (F.sum("toxic") * sign).alias("toxic"))

    first = rows.filter("id is not null").groupBy("sha").agg(F.min("id").alias("id"))
    originals = rows.join(first, ["sha", "id"]).select(rows.columns).unionByName(rows.filter("id is null"))
    moved = counted(originals, 1, 0).unionByName(counted(originals, -1, 1 << COPY))
    return (counted(rows, 1, 1 << COPY).unionByName(moved).groupBy("part", "mask")
            .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n > 0"))


def lattice(counts: DataFrame, k: int) -> DataFrame:
    """``(part, alive)``: rows, good and toxic rows alive in each of the ``2^k`` states."""
    if k > MAX_FILTERS:
        raise ValueError(f"{k} filters: at most {MAX_FILTERS} are audited order by order")
    at = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("state"))
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0
    states = at.groupBy("part", "state").agg(*[F.sum(F.when(alive, F.col(c)).otherwise(0)).alias(c)
                                               for c in ("n", "good", "toxic")])
    return states.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("state", "n", "good", "toxic"))).alias("alive"))


def edges(states: DataFrame, k: int) -> DataFrame:
    """``(part, state, filter, ...)``: what each edge of the lattice removes, and ``shapley``,
    the filter's removals summed over all orders: edge removals weighed by the paths through."""
    reach, leave = path_counts(k)
    full = (1 << k) - 1
    steps = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(s | 1 << f).alias("after"),
                               F.lit(reach[s] * leave[s | 1 << f]).cast("long").alias("paths"))
                      for s in range(full) for f in range(k) if not s >> f & 1])
    at = states.select("part", "alive", F.explode(steps).alias("e")).select("part", "alive", "e.*")

    def of(state, c: str = "n") -> Column:
        return F.element_at("alive", state + F.lit(1))[c]

    bit = F.col("bit")
    lost = lambda c: of(F.col("state"), c) - of(F.col("after"), c)
    at = at.select("part", "state", "filter", "paths", of(F.col("after")).alias("kept"), lost("n").alias("removed"),
                   (of(F.lit(0)) - of(bit)).alias("fails"),
                   (of(F.lit(full) - bit) - of(F.lit(full))).alias("unique_fails"),
                   lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    one = Window.partitionBy("part", "filter")            # 2^(k-1) edges
    return at.withColumn("shapley", F.sum(F.col("paths") * F.col("removed")).over(one))


def orders(edge_table: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, read from the edges."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[x] for x in order), step, state, f))
            state |= 1 << f
    walk = edge_table.sparkSession.createDataFrame(rows, "filter_order string, step int, state int, filter int")
    return edge_table.join(F.broadcast(walk), ["state", "filter"]).select(     # k! x k rows, a constant
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the five filters over ``docs``, per source."""
    counts = mask_counts(audit_rows(docs, labels))
    return orders(edges(lattice(counts, len(FILTERS)), len(FILTERS)), FILTERS)
