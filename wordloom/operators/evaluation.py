"""Evaluation by answer-likelihood (F1-F11) with a pluggable scorer.

``context_scores`` hands whole id sequences to any model, such as ``SuffixModel``. The
other queries use the count-based bigram model of F10, which needs ``(prev, cur)``
pairs only. Both stand in for the trained network: their numbers are not comparable
with a neural model's. Every candidate option of
every question is scored in one distributed job.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import ranked_rows
from ..functions.text import byte_ids, py_strip, r6
from ..session import stored
from .bpe import BpeModel
from .chat import mcq_valid
from .tokenizer import encode

QA_OPTIONS = ("yes", "no", "maybe")   # fixed values
RANK_BUCKET = 64
MCQ_CHANCE, QA_CHANCE = 0.25, 1 / 3


# --- F10: count-based scorer -------------------------------------------------------

@dataclass
class BigramScorer:
    """``p(w|v) = lam * c(v,w)/c(v) + (1-lam) * (c(w)+1)/(N+V)``.

    ``bigrams`` grows with the vocabulary squared at most and is joined by
    shuffle; ``unigrams`` and ``contexts`` have one row per token id (bounded by
    the vocabulary) and are broadcast.
    """
    bigrams: DataFrame     # v, w, c
    unigrams: DataFrame    # w, cw
    contexts: DataFrame    # v, cv
    n_tokens: int
    vocab_size: int
    lam: float = 0.9

    def score_pairs(self, pairs: DataFrame, prev: str = "prev", cur: str = "cur") -> DataFrame:
        """Adds ``logp`` to a frame of token pairs."""
        b = self.bigrams.select(F.col("v").alias(prev), F.col("w").alias(cur), F.col("c"))
        j = pairs.join(b, [prev, cur], "left")
        j = j.join(F.broadcast(self.unigrams.select(F.col("w").alias(cur), "cw")), cur, "left")
        j = j.join(F.broadcast(self.contexts.select(F.col("v").alias(prev), "cv")), prev, "left")
        big = F.when(F.col("cv") > 0, F.coalesce(F.col("c"), F.lit(0)) / F.col("cv")) \
            .otherwise(F.lit(0.0))
        uni = (F.coalesce(F.col("cw"), F.lit(0)) + 1) / F.lit(float(self.n_tokens + self.vocab_size))
        p = F.lit(self.lam) * big + F.lit(1.0 - self.lam) * uni
        return j.withColumn("logp", F.log(p)).drop("c", "cw", "cv")

    def with_lambda(self, lam: float) -> "BigramScorer":
        """The same count tables with another interpolation weight."""
        return BigramScorer(self.bigrams, self.unigrams, self.contexts, self.n_tokens,
                            self.vocab_size, lam)


BLOCKS_AT_ONCE = 256      # blocks summed together: about a million tokens


def _token_arrays(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The token lists of some rows after one another, and each token's place in its own list."""
    for batch in batches:
        for i in range(0, len(batch), BLOCKS_AT_ONCE):
            lists = batch.slice(i, BLOCKS_AT_ONCE).column(column)
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield flat, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of ids from 0 up, and how often each comes. Columns that fit
    63 bits together are sorted as one number."""
    width = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(width) < 64:
        key = np.zeros(len(columns[0]), np.int64)
        for c, bits in zip(columns, width):
            key = key << bits | c
        key.sort()
        at = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        count, key, out = np.diff(np.concatenate([at, [len(key)]])), key[at], []
        for bits in reversed(width):
            out.append(key & (1 << bits) - 1)
            key = key >> bits
        return out[::-1], count
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.concatenate([at, [len(order)]]))


def bigram_counts(blocks: DataFrame, split: str = "train") -> DataFrame:
    """Adjacent-token counts over the stored corpus of one split: pairs inside
    each block plus the pair across each block boundary. Some blocks at a time are
    summed as arrays, so a row per distinct pair leaves them, not one per token."""
    b = blocks.filter(F.col("split") == split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, place in _token_arrays(batches, "toks"):
            at = np.flatnonzero(place > 0)
            (v, w), c = _distinct(flat[at - 1], flat[at])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(w, pa.int32()), pa.array(c, pa.int64())], names=["v", "w", "c"])

    inner = b.select("toks").mapInArrow(run, "v int, w int, c bigint")
    ends = b.select("source", "block_id", F.element_at("toks", 1).alias("first"),
                    F.element_at("toks", -1).alias("last"))
    nxt = ends.select("source", (F.col("block_id") - 1).alias("block_id"), F.col("first").alias("w"))
    cross = ends.join(nxt, ["source", "block_id"]).select(F.col("last").alias("v"), "w", F.lit(1).cast("bigint").alias("c"))
    return inner.unionByName(cross).groupBy("v", "w").agg(F.sum("c").alias("c"))


def fit_bigram(blocks: DataFrame, vocab_size: int, lam: float = 0.9) -> BigramScorer:
    """the bigram table is materialised once (reliable checkpoint); the
    unigram and context counts follow from it exactly - every token but the
    first of each (source, train) array is the right side of one bigram - so
    the corpus is exploded only once."""
    from ..session import checkpoint_dir
    checkpoint_dir(blocks.sparkSession)
    big = bigram_counts(blocks).checkpoint(eager=True)
    firsts = (blocks.filter((F.col("split") == "train") & (F.col("block_id") == 0))
              .select(F.element_at("toks", 1).alias("w"), F.lit(1).cast("bigint").alias("c")))
    uni = (big.select("w", "c").unionByName(firsts).groupBy("w").agg(F.sum("c").alias("cw"))
           .persist())
    ctx = big.groupBy("v").agg(F.sum("c").alias("cv")).persist()
    n = uni.agg(F.sum("cw")).first()[0] or 0
    return BigramScorer(big, uni, ctx, int(n), vocab_size, lam)


# --- F1-F3: candidates and prompts ------------------------------------------------------

def first_n(df: DataFrame, n: int | None, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows by ``order`` (the evaluation limit is the feature).

    A prefix count of keys rather than ``orderBy().limit()``, whose final
    merge would gather ``n`` rows from every partition into one task; ranges
    that start past ``n`` are dropped before the row-level window."""
    if not n:
        return df
    return ranked_rows(df, [], order, "__rank", n).drop("__rank")


def mcq_candidates(mcq: DataFrame, limit: int | None) -> DataFrame:
    """F1 + F3: first ``limit`` valid rows, four options each."""
    v = first_n(mcq_valid(mcq), limit)
    ctx = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer:"))
    opts = F.array("opa", "opb", "opc", "opd")
    return v.select(F.lit("mcq").alias("task"), "row_id", ctx.alias("context"),
                    F.col("cop").alias("gold"), F.posexplode(opts).alias("idx", "option"))


def qa_candidates(qa: DataFrame, limit: int | None) -> DataFrame:
    """F2 + F3: rows whose stripped, lower-cased decision is yes/no/maybe; three options."""
    gold = F.lower(py_strip(F.coalesce(F.col("final_decision"), F.lit(""))))
    g = qa.select("row_id", "question", gold.alias("gold_text"))
    v = first_n(g.filter(F.col("gold_text").isin(*QA_OPTIONS)), limit)
    ctx = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer:"))
    gold_idx = F.array_position(F.array(*[F.lit(o) for o in QA_OPTIONS]), F.col("gold_text")) - 1
    return v.select(F.lit("qa").alias("task"), "row_id", ctx.alias("context"),
                    gold_idx.cast("int").alias("gold"),
                    F.posexplode(F.array(*[F.lit(o) for o in QA_OPTIONS])).alias("idx", "option"))


def candidate_tokens(cands: DataFrame, model: BpeModel | None, max_len: int) -> DataFrame:
    """ids of context and " " + option, cut to the last ``max_len``; a kept
    option token whose predecessor was cut away is not scored."""
    keys = ["task", "row_id", "idx"]
    t = cands.select(*keys, "context", F.concat(F.lit(" "), F.col("option")).alias("opt"))
    if model is None or not model.merges:
        e = t.select(*keys, byte_ids(F.col("context")).alias("ctx"), byte_ids(F.col("opt")).alias("oid"))
    else:
        e = encode(t, model, keys, text=["context", "opt"], out=["ctx", "oid"])
    full = F.concat("ctx", "oid")
    return e.select(*keys, full.alias("ids"), F.size("oid").alias("n_opt"),
                    F.size("ctx").alias("n_ctx"),
                    F.greatest(F.size(full) - max_len, F.lit(0)).alias("cut"))


def option_scores(tokens: DataFrame, scorer: BigramScorer) -> DataFrame:
    """mean log-probability of each option's tokens given what precedes them."""
    keys = ["task", "row_id", "idx"]
    lo = F.greatest(F.col("n_ctx"), F.col("cut") + 1)        # first scorable position (0-based)
    hi = F.col("n_ctx") + F.col("n_opt") - 1
    pos = tokens.select(*keys, "ids", "n_opt",
                        F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("j"))
    pairs = pos.select(*keys, F.element_at("ids", F.col("j")).alias("prev"),
                       F.element_at("ids", F.col("j") + 1).alias("cur"))
    s = scorer.score_pairs(pairs).groupBy(*keys).agg(F.sum("logp").alias("tot"))
    base = tokens.select(*keys, "n_opt")
    j = base.join(s, keys, "left")
    score = F.coalesce(F.col("tot"), F.lit(0.0)) / F.greatest(F.col("n_opt"), F.lit(1))
    return j.select(*keys, score.alias("score"))


def context_scores(tokens: DataFrame, make_predict, max_len: int, batch_size: int = 128) -> DataFrame:
    """F4 with any model that sees the whole context. ``make_predict()`` is called once in each
    Python worker and gives ``predict(ids)``: a batch of id sequences as a matrix, padded with
    ``PAD``, to the log-probability of each id given all before it (the first is ignored).
    Sequences are batched with others of about their length: buckets double up to
    ``max_len``, so at most half of a matrix is padding."""
    keys = ["task", "row_id", "idx"]
    kept = F.slice("ids", (F.col("cut") + 1).cast("int"), F.size("ids"))
    first = F.greatest(F.col("n_ctx"), F.col("cut") + 1) - F.col("cut")
    t = stored(tokens.select(*keys, kept.alias("ids"), first.cast("int").alias("first"), "n_opt"), "option-tokens")
    out, low = None, 0
    while low < max_len:
        length = min(max(2 * low, 32), max_len)
        model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                                  input_tensor_shapes=[[length]])
        own = t.filter((F.size("ids") > low) & (F.size("ids") <= length))
        padded = F.concat("ids", F.array_repeat(F.lit(PAD), F.lit(length) - F.size("ids")))
        scored = own.select(*keys, "n_opt", F.slice(model(padded), F.col("first") + 1, F.greatest(F.size("ids") - F.col("first"), F.lit(0))).alias("p"))
        out = scored if out is None else out.unionByName(scored)
        low = length
    total = F.aggregate("p", F.lit(0.0), lambda x, y: x + y)
    none = t.filter(F.size("ids") == 0).select(*keys, F.lit(0.0).alias("score"))
    return out.select(*keys, (total / F.greatest(F.col("n_opt"), F.lit(1))).alias("score")).unionByName(none)


# --- a count model of longer contexts ----------------------------------------------------

PAD = -1
SUFFIX = 3               # tokens of context the model can use
SLOT = 17                # bits of one context token: id + 1, 0 before the start
NO_TOKEN = (1 << SLOT) - 1     # a place that truncation cut away: never counted


def suffix_counts(blocks: DataFrame, depth: int = SUFFIX, split: str = "train") -> DataFrame:
    """``(ctx, w, c)``: how often ``w`` follows the ``depth`` tokens packed in ``ctx``, the nearest in
    the lowest bits, so that a mask gives the shorter contexts. Blocks meet the tail of the
    block before them on their bucket keys."""
    own = blocks.filter(F.col("split") == split).select("source", "split", "block_id", "toks")
    tails = own.select("source", "split", (F.col("block_id") + 1).alias("block_id"), F.slice("toks", -depth, depth).alias("tail"))
    start = F.array_repeat(F.lit(PAD), depth)
    rows = own.join(tails, ["source", "split", "block_id"], "left").select(
        F.concat(F.coalesce("tail", start), "toks").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat, place in _token_arrays(batches, "x"):
            at = np.flatnonzero(place >= depth)
            (w, *before), c = _distinct(flat[at], *(flat[at - back] + 1 for back in range(1, depth + 1)))
            ctx = sum(x << SLOT * k for k, x in enumerate(before))
            yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.int64()), pa.array(w, pa.int32()), pa.array(c, pa.int64())], names=["ctx", "w", "c"])

    return rows.mapInArrow(run, "ctx bigint, w int, c bigint").groupBy("ctx", "w").agg(F.sum("c").alias("c"))


class SuffixModel:
    """``p_0(w) = (c(w) + 1) / (N + V)`` and ``p_k(w | k tokens) = (c(k tokens, w) + p_(k-1)) / (c(k tokens) + 1)``:
    the longest suffix that was seen decides, and an unseen one leaves ``p`` as it is. Holds
    only the contexts that some candidate asks for."""

    def __init__(self, unigrams: np.ndarray, n_tokens: int, contexts: list[tuple], pairs: list[tuple]):
        self.p0 = (unigrams + 1) / (n_tokens + len(unigrams))
        self.contexts, self.pairs = contexts, pairs        # by k: sorted keys and counts

    @staticmethod
    def _count(table: tuple, key: np.ndarray) -> np.ndarray:
        keys, counts = table
        if not len(keys):
            return np.zeros(key.shape)
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[i] == key, counts[i], 0)

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.astype(np.int64)
        inside = (ids >= 0) & (ids < len(self.p0))
        p = np.where(inside, self.p0[np.where(inside, ids, 0)], 1.0)
        ctx = np.zeros(ids.shape, np.int64)
        for k, (contexts, pairs) in enumerate(zip(self.contexts, self.pairs), 1):
            before = np.full(ids.shape, NO_TOKEN, np.int64)
            before[:, k:] = ids[:, :-k] + 1
            ctx += before << SLOT * (k - 1)
            row = np.searchsorted(contexts[0], ctx)        # a context's place keys its pairs
            p = (self._count(pairs, row << SLOT | np.where(inside, ids, 0)) * self._known(contexts[0], row, ctx) + p) / \
                (self._count(contexts, ctx) + 1)
        return np.log(p)

    @staticmethod
    def _known(keys: np.ndarray, row: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        return keys[np.minimum(row, len(keys) - 1)] == ctx if len(keys) else np.zeros(ctx.shape, bool)


def fit_suffix_model(counts: DataFrame, tokens: DataFrame, vocab_size: int, depth: int = SUFFIX) -> SuffixModel:
    """The part of the model that ``tokens`` (candidates of a limited evaluation) ask for; what is
    gathered is at most ``depth`` counts per candidate token and one per id."""
    counts = stored(counts, "suffix-counts")
    lo, hi = F.greatest(F.col("n_ctx"), F.col("cut") + 1), F.col("n_ctx") + F.col("n_opt") - 1
    pos = tokens.select("ids", "cut", F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("j"))
    ctx, asked = F.lit(0).cast("bigint"), []
    for k in range(1, depth + 1):
        token = F.when(F.col("j") - k >= F.col("cut"), F.try_element_at("ids", (F.col("j") - k + 1).cast("int")) + 1).otherwise(NO_TOKEN)
        ctx = ctx + F.shiftleft(token.cast("bigint"), SLOT * (k - 1))
        asked.append(F.struct(F.lit(k).alias("k"), ctx.alias("ctx"), F.element_at("ids", F.col("j") + 1).alias("w")))
    asked = stored(pos.select(F.inline(F.array(*asked))).distinct(), "suffix-asked")
    contexts, pairs = [], []
    for k in range(1, depth + 1):
        own = asked.filter(F.col("k") == k)
        short = counts.select(F.col("ctx").bitwiseAND(F.lit((1 << SLOT * k) - 1)).alias("ctx"), "w", "c")
        seen = stored(short.join(own.select("ctx").distinct(), "ctx", "left_semi").groupBy("ctx", "w").agg(F.sum("c").alias("c")), "suffix-seen")
        total = {r["ctx"]: r["c"] for r in seen.groupBy("ctx").agg(F.sum("c").alias("c")).collect()}
        keys = np.array(sorted(total), np.int64)
        contexts.append((keys, np.array([total[x] for x in keys.tolist()], np.int64)))
        hit = seen.join(own.select("ctx", "w"), ["ctx", "w"], "left_semi").collect()
        rows = sorted((int(np.searchsorted(keys, r["ctx"])) << SLOT | r["w"], r["c"]) for r in hit)
        pairs.append((np.array([x for x, _ in rows], np.int64), np.array([c for _, c in rows], np.int64)))
    unigrams = np.zeros(vocab_size, np.int64)
    for r in counts.groupBy("w").agg(F.sum("c").alias("c")).collect():
        unigrams[r["w"]] = r["c"]
    return SuffixModel(unigrams, int(unigrams.sum()), contexts, pairs)


def predictions(scores: DataFrame, cands: DataFrame) -> DataFrame:
    """arg-max option per question; ties go to the lowest index."""
    best = scores.groupBy("task", "row_id").agg(
        F.max_by("idx", F.struct(F.col("score"), (-F.col("idx")).alias("neg"))).alias("pred"))
    gold = cands.select("task", "row_id", "gold").distinct()
    j = best.join(gold, ["task", "row_id"])
    return j.withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))


def accuracy(preds: DataFrame) -> DataFrame:
    """accuracy per task next to chance; an empty task gives null."""
    chance = F.when(F.col("task") == "mcq", F.lit(MCQ_CHANCE)).otherwise(F.lit(QA_CHANCE))
    return preds.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").cast("bigint").alias("correct")) \
        .select("task", "n", "correct",
                r6(F.try_divide(F.col("correct"), F.col("n"))).alias("accuracy"),
                r6(chance).alias("chance"))


def compare_models(acc: DataFrame, base: str, tuned: str) -> DataFrame:
    """F8: base vs tuned accuracy per task with the difference."""
    p = acc.groupBy("task").pivot("model", [base, tuned]).agg(F.first("accuracy"))
    return p.select("task", F.col(base).alias("base"), F.col(tuned).alias("tuned"),
                    r6(F.col(tuned) - F.col(base)).alias("delta"))


def heldout_loss(windows: DataFrame, scorer: BigramScorer) -> DataFrame:
    """cross-entropy per source = mean over batches of the batch mean over
    target tokens (targets of -1 excluded); ``val_avg`` is the unweighted mean
    over sources. Windows carry ``loader, batch_id, seq_in_batch, x, y``."""
    keys = ["loader", "eval_round", "batch_id", "seq_in_batch"]
    pairs = windows.select(*keys, F.posexplode(F.arrays_zip(F.col("x").alias("prev"),
                                                           F.col("y").alias("cur"))).alias("t", "p"))
    pairs = pairs.select(*keys, "p.prev", "p.cur").filter(F.col("cur") != -1)
    s = scorer.score_pairs(pairs)
    per_batch = s.groupBy("loader", "eval_round", "batch_id").agg((-F.avg("logp")).alias("loss"))
    per_src = per_batch.groupBy("loader", "eval_round").agg(F.avg("loss").alias("loss"))
    avg = per_src.groupBy("eval_round").agg(F.avg("loss").alias("loss")) \
        .withColumn("loader", F.lit("avg"))
    out = per_src.unionByName(avg)
    return out.select(F.col("eval_round"), F.concat(F.lit("val_"), F.col("loader")).alias("series"),
                      r6(F.col("loss")).alias("loss"))


def topk_candidates(scorer: BigramScorer, k: int) -> DataFrame:
    """Every ``(prev, cur)`` pair that can reach the top ``k`` of its context
    over the *whole* vocabulary, without scoring the full vocab x vocab grid.

    A successor never seen after ``prev`` scores by its unigram count alone,
    so it can only make the top ``k`` (ties included) if its global rank by
    unigram count is at most ``k + m`` where ``m`` is the number of observed
    successors of ``prev``. The vocabulary table has one row per id (bounded
    by the vocabulary), so it is ranked in one window and broadcast.
    """
    spark = scorer.bigrams.sparkSession
    vocab = spark.range(scorer.vocab_size).select(F.col("id").cast("int").alias("cur"))
    vocab = vocab.join(F.broadcast(scorer.unigrams.select(F.col("w").cast("int").alias("cur"), "cw")),
                       "cur", "left").withColumn("cw", F.coalesce("cw", F.lit(0)))
    ranked = vocab.withColumn("grank", F.rank().over(Window.orderBy(F.desc("cw"))))  # <= vocab rows
    observed = scorer.bigrams.select(F.col("v").alias("prev"), F.col("w").alias("cur"))
    m = observed.groupBy("prev").agg(F.count(F.lit(1)).alias("m"))
    # ranks meet their contexts by bucket: an equi-join that yields the first k + m only
    near = (m.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") + k) / RANK_BUCKET).cast("int"))))
            .join(ranked.select("cur", "grank", F.floor(F.col("grank") / RANK_BUCKET).cast("int").alias("bucket")), "bucket")
            .filter(F.col("grank") <= F.col("m") + F.lit(k)).select("prev", "cur"))
    unseen = near.join(observed, ["prev", "cur"], "left_anti")
    return observed.unionByName(unseen)


def topk_distribution(scorer: BigramScorer, k: int, temperature: float) -> DataFrame:
    """per context token, next-token probabilities after temperature and
    top-k over the whole vocabulary (every candidate tied with the k-th is
    kept), softmax over the kept ones."""
    pairs = topk_candidates(scorer, k)
    s = scorer.score_pairs(pairs).withColumn("logit", F.col("logp") / F.lit(max(temperature, 1e-6)))
    w = Window.partitionBy("prev").orderBy(F.desc("logit"))  # one context: <= vocab rows
    kept = s.withColumn("rk", F.rank().over(w)).filter(F.col("rk") <= k)
    wp = Window.partitionBy("prev")
    e = kept.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(wp)))
    return e.select("prev", "cur", r6(F.col("e") / F.sum("e").over(wp)).alias("prob"))
