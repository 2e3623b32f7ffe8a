"""Registered queries: one per operator of SURVEY section 2, each ``(spark, sf_dir) -> DataFrame``.

Results are flat rows (arrays leave as space-joined strings, doubles rounded to
six places) so the DuckDB oracle in ``oracle.py`` can be compared value by value.
Parameters shared with the oracle live in ``params.py``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ids_string, pieces, r6
from ..operators import chat as ch
from ..operators import evaluation as ev
from ..operators import metrics as mt
from ..operators import mixing as mx
from ..operators import tokenizer as tk
from ..operators import tokens as tok
from ..operators.bpe import BpeModel, learn_merges, pair_counts
from ..sources import files as fs
from ..sources import tables
from ..streaming import ingest as st
from ..sources.corpus import SourceSpec, scan_sources
from . import corpus_build as cb
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- cached learned tokenizer (B6 is the expensive step; queries share it) -----
_MODELS: dict[tuple, BpeModel] = {}


def trained_model(spark: SparkSession, sf_dir: str, vocab_size: int | None = None) -> BpeModel:
    vocab_size = vocab_size or P.VOCAB
    key = (spark.sparkContext.applicationId, sf_dir, vocab_size)
    if key not in _MODELS:
        pc = tk.training_pieces(tables.corpus(spark, sf_dir), P.TOK_DOCS)
        _MODELS[key] = learn_merges(pc, vocab_size)
    return _MODELS[key]


# --- A: scans and sources ---------------------------------------------------------

@query("a1_corpus_scan")
def a1_corpus_scan(spark, sf):
    c = tables.corpus(spark, sf)
    return c.select("source", "ord", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"),
                    F.md5("text").alias("text_md5"))


def _multi_specs(sf: str) -> list[SourceSpec]:
    rd = lambda name: (lambda s: tables.table(s, sf, name))
    return [
        SourceSpec("documents", rd("documents"), "text", "doc_id"),
        SourceSpec("conversations", rd("conversations"), "text", "conv_id * 1000 + turn"),
        SourceSpec("benchmark", rd("benchmark"), "text", "item_id"),
        # no 'text' field here: A2 falls back to the first string longer than 20 chars
        SourceSpec("pages", rd("pages"), "text", "page_id"),
    ]


@query("a1_multi_source_scan")
def a1_multi_source_scan(spark, sf):
    c = scan_sources(spark, _multi_specs(sf))
    return c.select("source", F.col("ord").cast("int").alias("ord"), "doc_id",
                    F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("a3_doc_cap")
def a3_doc_cap(spark, sf):
    c = tables.corpus(spark, sf, max_docs=P.CAP_DOCS)
    return c.select("source", "doc_id")


# --- B: tokenizer -----------------------------------------------------------------

@query("b1_blend")
def b1_blend(spark, sf):
    b = tk.blend(tables.corpus(spark, sf), P.BLEND_DOCS)
    return b.select("source", F.col("ord").cast("int").alias("ord"), "doc_id",
                    F.col("k").cast("bigint").alias("k"))


@query("b2_char_cap")
def b2_char_cap(spark, sf):
    b = tk.cap_chars(tk.blend(tables.corpus(spark, sf), None))
    return b.select("source", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


@query("b3_pretokenize")
def b3_pretokenize(spark, sf):
    c = tables.corpus(spark, sf).select("source", "doc_id", pieces(F.col("text")).alias("p"))
    return c.select("source", "doc_id", F.size("p").cast("bigint").alias("n_pieces"),
                    F.md5(F.array_join("p", "\u0001")).alias("pieces_md5"))


@query("b4_piece_counts")
def b4_piece_counts(spark, sf):
    return tk.training_pieces(tables.corpus(spark, sf), P.TOK_DOCS) \
        .select("piece", F.col("n").cast("bigint").alias("n"))


@query("b5_pair_counts")
def b5_pair_counts(spark, sf):
    from ..functions.text import byte_ids
    pc = tk.training_pieces(tables.corpus(spark, sf), P.TOK_DOCS)
    state = pc.select(byte_ids(F.col("piece")).alias("sym"), F.col("n").cast("bigint"))
    return pair_counts(state).select(F.col("l").cast("int").alias("l"),
                                     F.col("r").cast("int").alias("r"),
                                     F.col("c").cast("bigint").alias("c"))


@query("b6_learn_merges")
def b6_learn_merges(spark, sf):
    m = trained_model(spark, sf)
    return m.merges_df(spark)


@query("b7_vocab")
def b7_vocab(spark, sf):
    return trained_model(spark, sf).vocab_df(spark).select("id", "token_hex", "special")


@query("b8_encode_bytes")
def b8_encode_bytes(spark, sf):
    e = tk.encode(tables.corpus(spark, sf), None, ["source", "doc_id"])
    return e.select("source", "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    ids_string(F.col("ids")).alias("ids"))


@query("b8_encode_merged")
def b8_encode_merged(spark, sf):
    m = trained_model(spark, sf)
    e = tk.encode(tables.corpus(spark, sf), m, ["source", "doc_id"])
    return e.select("source", "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    ids_string(F.col("ids")).alias("ids"))


@query("b8_encode_dictionary")
def b8_encode_dictionary(spark, sf):
    """``b8_encode_merged`` by way of the stored dictionary of pieces."""
    words = tk.PieceDictionary(spark, fs.scratch_path(spark, "pieces"), trained_model(spark, sf))
    c = words.number(tables.corpus(spark, sf), ["source", "doc_id"])
    words.extend(c)
    e = words.encode(c, ["source", "doc_id"])
    return e.select("source", "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    ids_string(F.col("ids")).alias("ids"))


@query("b9_decode")
def b9_decode(spark, sf):
    e = tk.encode(tables.corpus(spark, sf), None, ["source", "doc_id"])
    return tk.decode(e, None, ["source", "doc_id"]).select("source", "doc_id", "text")


@query("b10_roundtrip_audit")
def b10_roundtrip_audit(spark, sf):
    return tk.roundtrip_audit(tables.corpus(spark, sf), trained_model(spark, sf))


@query("b11_fertility")
def b11_fertility(spark, sf):
    return tk.fertility(tables.corpus(spark, sf), None)


@query("b12_special_audit")
def b12_special_audit(spark, sf):
    """The reserved specials and those that chats call for, against the stored learned vocabulary."""
    path = fs.scratch_path(spark, "tokenizer")
    fs.save_tokenizer(spark, trained_model(spark, sf), path)
    reserved = tk.reserved_specials(spark)
    called = tk.declared_specials(tables.table(spark, sf, "conversations", ["role"]))
    audit = tk.special_audit(fs.read_vocab(spark, path), reserved.select("text").unionByName(called))
    return audit.join(reserved, "text", "left").select("text", "declared", "id", "resolved")


# --- C: token corpus ----------------------------------------------------------------

def _lengths(spark, sf):
    return cb.byte_lengths(tables.corpus(spark, sf))


@query("c1_eot_append")
def c1_eot_append(spark, sf):
    e = tok.append_eot(tk.encode(tables.corpus(spark, sf), None, ["source", "doc_id"]))
    return e.select("source", "doc_id", F.size("ids").cast("bigint").alias("n"),
                    F.element_at("ids", -1).alias("last_id"))


@query("c2_budget_cut")
def c2_budget_cut(spark, sf):
    k = tok.budget_cut(_lengths(spark, sf), P.BUDGET)
    return k.select("source", "doc_id", F.col("off").cast("bigint").alias("off"), "m")


@query("c2_source_budgets")
def c2_source_budgets(spark, sf):
    k = tok.budget_cut(_lengths(spark, sf), P.SOURCE_BUDGETS)
    return k.select("source", "doc_id", F.col("off").cast("bigint").alias("off"), "m")


@query("c3_head_split_merged")
def c3_head_split_merged(spark, sf):
    s = cb.token_segments(tables.corpus(spark, sf), trained_model(spark, sf), P.BUDGET // 2)
    return s.select("source", "split", "doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("len").cast("bigint").alias("len"))


@query("c3_head_split")
def c3_head_split(spark, sf):
    s = cb.length_segments(tables.corpus(spark, sf), P.BUDGET)
    return s.select("source", "split", "doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("len").cast("bigint").alias("len"))


@query("c4_progress_marks")
def c4_progress_marks(spark, sf):
    return tok.progress_marks(_lengths(spark, sf), P.BUDGET, P.PROGRESS_STEP) \
        .select("source", "doc_id", F.col("total").cast("bigint").alias("total"))


@query("c5_corpus_report")
def c5_corpus_report(spark, sf):
    return tok.corpus_report(cb.length_segments(tables.corpus(spark, sf), P.BUDGET))


@query("c6_id_guard")
def c6_id_guard(spark, sf):
    segs = cb.token_segments(tables.corpus(spark, sf), None, None)
    return tok.id_guard(segs, P.BYTE_VOCAB)


@query("c6_build_watch")
def c6_build_watch(spark, sf):
    """What a build reports of its own write: blocks, tokens, val tokens and the range of ids."""
    watch = Observation("build")
    cb.stored_blocks(tables.corpus(spark, sf), None, P.BUDGET, build=watch)
    return spark.createDataFrame([Row(**watch.get)], "blocks bigint, tokens bigint, val_tokens bigint, min_id int, max_id int")


@query("a5_token_blocks")
def a5_token_blocks(spark, sf):
    segs = cb.token_segments(tables.corpus(spark, sf), None, None, short=True)
    b = tok.to_blocks(segs)
    return b.select("source", "split", "block_id", F.size("toks").cast("bigint").alias("n"),
                    ids_string(F.col("toks")).alias("toks"))


# --- D: mixing loader ---------------------------------------------------------------

_BLOCKS: dict[tuple, str] = {}


def byte_blocks(spark, sf):
    """The stored token corpus at byte level, written once per session like the
    reference's token files; every loader joins the same buckets."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BLOCKS:
        path = fs.scratch_path(spark, "blocks")
        cb.stored_blocks(tables.corpus(spark, sf), None, path=path)
        _BLOCKS[key] = path
    return fs.read_buckets(spark, _BLOCKS[key])


def byte_split_lengths(spark, sf):
    """Tokens per source and split, from text lengths alone: no block is built."""
    return cb.split_lengths(tables.corpus(spark, sf))


@query("d1_split_resolution")
def d1_split_resolution(spark, sf):
    r = mx.resolve_mix(mx.mix_frame(spark, P.MIX), byte_split_lengths(spark, sf), "val", P.SEQ_LEN)
    return r.select("source", "ord", "read_split", "n", "fell_back", "drop_reason")


@query("d3_mix_weights")
def d3_mix_weights(spark, sf):
    b = mx.mix_bounds(mx.resolve_mix(mx.mix_frame(spark, P.MIX), byte_split_lengths(spark, sf), "train", P.SEQ_LEN))
    return b.select("source", "n", r6(F.col("p")).alias("p"), r6(F.col("lo")).alias("lo"),
                    r6(F.col("hi")).alias("hi"))


@query("d4_source_picks")
def d4_source_picks(spark, sf):
    b = mx.resolved_bounds(spark, byte_split_lengths(spark, sf), P.MIX, "train", P.SEQ_LEN)
    d = mx.draw_windows(spark, b, P.N_BATCHES * P.BATCH, P.SEQ_LEN, P.BATCH, P.SEED, "train")
    return d.select("i", "source", "start")


@query("d6_mixed_windows")
def d6_mixed_windows(spark, sf):
    w = mx.mixed_batches(spark, byte_blocks(spark, sf), P.MIX, P.SEQ_LEN, P.BATCH,
                         P.N_BATCHES, P.SEED, lengths=byte_split_lengths(spark, sf))
    return mx.windows_as_strings(w)


@query("d9_batch_audit")
def d9_batch_audit(spark, sf):
    w = mx.mixed_batches(spark, byte_blocks(spark, sf), P.MIX, P.SEQ_LEN, P.BATCH,
                         P.N_BATCHES, P.SEED, lengths=byte_split_lengths(spark, sf))
    return mx.batch_audit(w, P.SEQ_LEN, P.BYTE_VOCAB)


@query("d10_run_plan")
def d10_run_plan(spark, sf):
    lengths = byte_split_lengths(spark, sf)
    presets = spark.createDataFrame(list(P.PRESETS),
                                    "preset string, seq_len int, batch_size int, grad_accum int, max_steps int")
    return mx.run_plan(presets, lengths)


@query("d11_val_windows")
def d11_val_windows(spark, sf):
    srcs = [s for s in P.MIX if s != "xx"]
    w = mx.val_windows(spark, byte_blocks(spark, sf), srcs, P.SEQ_LEN, P.VAL_BATCH,
                       P.VAL_BATCHES, P.EVAL_ROUNDS, P.SEED, lengths=byte_split_lengths(spark, sf))
    return w.select("loader", "eval_round", "batch_id", "seq_in_batch", "source", "split",
                    "start", ids_string(F.col("x")).alias("x"), ids_string(F.col("y")).alias("y"))


# --- E: instruction sets ----------------------------------------------------------------

def _chat_union(spark, sf):
    return ch.quota_union({
        "mcq": (ch.mcq_to_chat(tables.mcq(spark, sf)), P.QUOTAS["mcq"]),
        "qa": (ch.qa_to_chat(tables.qa(spark, sf)), P.QUOTAS["qa"]),
        "instr": (ch.instr_to_chat(tables.instr(spark, sf)), P.QUOTAS["instr"]),
    })


def _examples(spark, sf):
    return ch.truncate_examples(ch.chat_encode(_chat_union(spark, sf), None), P.SFT_MAX_LEN)


def _collated(spark, sf):
    b = ch.epoch_batches(_examples(spark, sf), P.SFT_EPOCHS, P.SFT_BATCH, P.SFT_SEED)
    return ch.collate(b)


@query("e1_mcq_pairs")
def e1_mcq_pairs(spark, sf):
    return ch.mcq_to_chat(tables.mcq(spark, sf))


@query("e2_qa_pairs")
def e2_qa_pairs(spark, sf):
    return ch.qa_to_chat(tables.qa(spark, sf))


@query("e3_instr_pairs")
def e3_instr_pairs(spark, sf):
    return ch.instr_to_chat(tables.instr(spark, sf))


@query("e4_source_quota")
def e4_source_quota(spark, sf):
    return _chat_union(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("first_row"),
        F.max("row_id").alias("last_row"))


@query("e5_chat_union")
def e5_chat_union(spark, sf):
    return _chat_union(spark, sf).select("source", "row_id", "user", "assistant")


@query("e6_seeded_shuffle")
def e6_seeded_shuffle(spark, sf):
    s = ch.seeded_shuffle(_chat_union(spark, sf), P.SFT_SEED)
    return s.select("source", "row_id", F.col("position").cast("bigint").alias("position"))


@query("e7_chat_encode")
def e7_chat_encode(spark, sf):
    e = ch.chat_encode(_chat_union(spark, sf), None)
    return e.select("source", "row_id", F.col("n_prompt").cast("int").alias("n_prompt"),
                    F.size("full").cast("int").alias("n_full"),
                    F.md5(ids_string(F.col("full"))).alias("full_md5"),
                    F.md5(ids_string(F.col("labels"))).alias("labels_md5"))


@query("e7_chat_encode_merged")
def e7_chat_encode_merged(spark, sf):
    e = ch.chat_encode(_chat_union(spark, sf), trained_model(spark, sf))
    return e.select("source", "row_id", F.col("n_prompt").cast("int").alias("n_prompt"),
                    F.size("full").cast("int").alias("n_full"),
                    F.md5(ids_string(F.col("full"))).alias("full_md5"))


@query("e8_truncate_mask")
def e8_truncate_mask(spark, sf):
    e = _examples(spark, sf)
    return e.select("source", "row_id", F.size("full").cast("int").alias("n_full"),
                    F.col("n_target").cast("int").alias("n_target"))


@query("e9_short_drop")
def e9_short_drop(spark, sf):
    enc = ch.chat_encode(_chat_union(spark, sf), None)
    kept = ch.truncate_examples(enc, P.SFT_MAX_LEN)
    a = enc.groupBy("source").agg(F.count(F.lit(1)).alias("encoded"))
    b = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"),
                                   F.sum(F.when(F.col("n_target") == 0, 1).otherwise(0))
                                   .cast("bigint").alias("no_target"))
    return a.join(b, "source", "left").select(
        "source", "encoded", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"),
        F.coalesce("no_target", F.lit(0)).cast("bigint").alias("no_target"))


@query("e10_epoch_batches")
def e10_epoch_batches(spark, sf):
    b = ch.epoch_batches(_examples(spark, sf), P.SFT_EPOCHS, P.SFT_BATCH, P.SFT_SEED)
    return b.select("epoch", "batch_id", "row", "source", "row_id")


@query("e11_collate")
def e11_collate(spark, sf):
    c = _collated(spark, sf)
    return c.select("epoch", "batch_id", "row", "source", "row_id", "n_pad",
                    F.size("x").cast("int").alias("width"),
                    F.md5(ids_string(F.col("x"))).alias("x_md5"),
                    F.md5(ids_string(F.col("y"))).alias("y_md5"))


@query("e12_inference_prompts")
def e12_inference_prompts(spark, sf):
    p = ch.inference_prompts(tables.table(spark, sf, "benchmark", ["item_id", "text"]), None)
    return p.select("item_id", ids_string(F.col("chat")).alias("chat"),
                    ids_string(F.col("plain")).alias("plain"))


@query("e14_padding_report")
def e14_padding_report(spark, sf):
    return ch.padding_report(ch.epoch_batches(_examples(spark, sf), P.SFT_EPOCHS, P.SFT_BATCH, P.SFT_SEED))


# --- F: evaluation ----------------------------------------------------------------------

def _scorer(spark, sf, lam: float = P.LAMBDA):
    return ev.fit_bigram(byte_blocks(spark, sf), P.BYTE_VOCAB, lam)


def _cands(spark, sf):
    return ev.mcq_candidates(tables.mcq(spark, sf), P.EVAL_LIMIT).unionByName(
        ev.qa_candidates(tables.qa(spark, sf), P.EVAL_LIMIT))


@query("f1_mcq_candidates")
def f1_mcq_candidates(spark, sf):
    c = ev.mcq_candidates(tables.mcq(spark, sf), P.EVAL_LIMIT)
    return c.select("row_id", F.col("idx").cast("int").alias("idx"), "option", "context", "gold")


@query("f2_qa_candidates")
def f2_qa_candidates(spark, sf):
    c = ev.qa_candidates(tables.qa(spark, sf), P.EVAL_LIMIT)
    return c.select("row_id", F.col("idx").cast("int").alias("idx"), "option", "context", "gold")


@query("f3_prompt_tokens")
def f3_prompt_tokens(spark, sf):
    t = ev.candidate_tokens(_cands(spark, sf), None, P.EVAL_MAX_LEN)
    return t.select("task", "row_id", F.col("idx").cast("int").alias("idx"),
                    F.col("n_ctx").cast("int").alias("n_ctx"), F.col("n_opt").cast("int").alias("n_opt"),
                    ids_string(F.col("ids")).alias("ids"))


@query("f10_bigram_counts")
def f10_bigram_counts(spark, sf):
    return ev.bigram_counts(byte_blocks(spark, sf)).select(
        F.col("v").cast("int").alias("v"), F.col("w").cast("int").alias("w"),
        F.col("c").cast("bigint").alias("c"))


@query("f4_option_scores")
def f4_option_scores(spark, sf):
    t = ev.candidate_tokens(_cands(spark, sf), None, P.EVAL_MAX_LEN)
    s = ev.option_scores(t, _scorer(spark, sf))
    return s.select("task", "row_id", F.col("idx").cast("int").alias("idx"),
                    r6(F.col("score")).alias("score"))


@query("f4_context_scores")
def f4_context_scores(spark, sf):
    """Each option given its whole kept context, by the longest suffix seen in training."""
    t = ev.candidate_tokens(_cands(spark, sf), None, P.EVAL_MAX_LEN)
    model = ev.fit_suffix_model(ev.suffix_counts(byte_blocks(spark, sf)), t, P.BYTE_VOCAB)
    s = ev.context_scores(t, lambda: model.log_probs, P.EVAL_MAX_LEN)
    return s.select("task", "row_id", F.col("idx").cast("int").alias("idx"), r6(F.col("score")).alias("score"))


@query("f4_suffix_counts")
def f4_suffix_counts(spark, sf):
    """The counts behind the context scores."""
    return ev.suffix_counts(byte_blocks(spark, sf)).select("ctx", F.col("w").cast("int").alias("w"), F.col("c").cast("bigint").alias("c"))


@query("f5_truncated_scores")
def f5_truncated_scores(spark, sf):
    t = ev.candidate_tokens(_cands(spark, sf), None, P.TRUNC_MAX_LEN)
    s = ev.option_scores(t, _scorer(spark, sf))
    return s.select("task", "row_id", F.col("idx").cast("int").alias("idx"),
                    r6(F.col("score")).alias("score"))


def _preds(spark, sf, scorer=None):
    c = _cands(spark, sf)
    scorer = scorer or _scorer(spark, sf)
    s = ev.option_scores(ev.candidate_tokens(c, None, P.EVAL_MAX_LEN), scorer)
    return ev.predictions(s, c)


@query("f6_predictions")
def f6_predictions(spark, sf):
    return _preds(spark, sf).select("task", "row_id", F.col("pred").cast("int").alias("pred"),
                                    F.col("gold").cast("int").alias("gold"), "correct")


@query("f7_accuracy")
def f7_accuracy(spark, sf):
    return ev.accuracy(_preds(spark, sf))


@query("f8_model_comparison")
def f8_model_comparison(spark, sf):
    tuned = _scorer(spark, sf)                       # count tables fitted once
    a = ev.accuracy(_preds(spark, sf, tuned.with_lambda(0.0))).withColumn("model", F.lit("unigram"))
    b = ev.accuracy(_preds(spark, sf, tuned)).withColumn("model", F.lit("bigram"))
    return ev.compare_models(a.unionByName(b), "unigram", "bigram")


@query("f9_heldout_loss")
def f9_heldout_loss(spark, sf):
    blocks = byte_blocks(spark, sf)
    srcs = [s for s in P.MIX if s != "xx"]
    w = mx.val_windows(spark, blocks, srcs, P.SEQ_LEN, P.VAL_BATCH, P.VAL_BATCHES,
                       P.EVAL_ROUNDS, P.SEED, lengths=byte_split_lengths(spark, sf))
    return ev.heldout_loss(w, ev.fit_bigram(blocks, P.BYTE_VOCAB, P.LAMBDA))


@query("f11_topk_next_token")
def f11_topk_next_token(spark, sf):
    t = ev.topk_distribution(_scorer(spark, sf), P.TOPK, P.TEMPERATURE)
    return t.select(F.col("prev").cast("int").alias("prev"), F.col("cur").cast("int").alias("cur"),
                    "prob")


# --- G: run metrics ----------------------------------------------------------------------

def _log(spark, sf):
    return mt.dedup_resumed(tables.metrics(spark, sf))


@query("g1_curves_long")
def g1_curves_long(spark, sf):
    c = mt.curves(_log(spark, sf))
    return c.select("run", "step", "series", r6(F.col("value")).alias("value"))


@query("g2_running_best")
def g2_running_best(spark, sf):
    b = mt.running_best(_log(spark, sf))
    return b.select("run", "step", r6(F.col("val_avg")).alias("val_avg"),
                    r6(F.col("best_before")).alias("best_before"), "is_best")


@query("g3_latest_state")
def g3_latest_state(spark, sf):
    s = mt.latest_state(_log(spark, sf))
    return s.select("run", "step", r6(F.col("val_avg")).alias("val_avg"),
                    r6(F.col("train_loss")).alias("train_loss"), r6(F.col("best_val")).alias("best_val"))


@query("g4_resume_dedup")
def g4_resume_dedup(spark, sf):
    d = _log(spark, sf)
    return d.select("run", "step", "ingest_seq", r6(F.col("train_loss")).alias("train_loss"))


@query("g5_throughput")
def g5_throughput(spark, sf):
    return mt.throughput(_log(spark, sf), P.TOKENS_PER_STEP)


@query("g6_lr_audit")
def g6_lr_audit(spark, sf):
    sched = mt.Schedule(*P.LR_SCHEDULE)
    a = mt.lr_audit(tables.metrics_scheduled(spark, sf, sched, P.LR_FAULT_EVERY), sched)
    return a.select("run", "step", "ingest_seq", r6(F.col("rel_err")).alias("rel_err"))


@query("g7_run_comparison")
def g7_run_comparison(spark, sf):
    r = mt.run_comparison(_log(spark, sf))
    return r.select("run", "series", r6(F.col("best")).alias("best"), F.col("rank").cast("int").alias("rank"))


@query("g8_start_end_gap")
def g8_start_end_gap(spark, sf):
    r = mt.start_end_report(_log(spark, sf))
    return r.select("run", "series", r6(F.col("first_value")).alias("first_value"),
                    r6(F.col("last_value")).alias("last_value"), r6(F.col("gap")).alias("gap"))


# --- A4-A9, S1-S3: sinks, sources and streams ----------------------------------------------

TRIGGERS = 4


def _document_files(spark, sf, base: str):
    """The documents as a folder of files, for streams of ``TRIGGERS`` triggers. The files are as many
    as the table's splits and more, so they grow in number and not in size."""
    path = st.sub(base, "files")
    docs = tables.table(spark, sf, "documents")
    each = -(-docs.rdd.getNumPartitions() // TRIGGERS) + 1 if docs.rdd.getNumPartitions() > TRIGGERS else 1
    docs.repartition(TRIGGERS * each, "doc_id").write.parquet(path)
    return st.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=each)


@query("a4_stream_ingest")
def a4_stream_ingest(spark, sf):
    base = fs.scratch_path(spark, "ingest")
    stream = _document_files(spark, sf, base)
    st.ingest_corpus(stream, "lang", tables.LANG_REGISTRY, st.sub(base, "out"), st.sub(base, "ckpt"))
    out = spark.read.parquet(st.sub(base, "out"))
    return out.select("source", "ord", "doc_id", F.md5("text").alias("text_md5"))


@query("a5_block_sink_roundtrip")
def a5_block_sink_roundtrip(spark, sf):
    path = fs.scratch_path(spark, "blocks")
    fs.write_blocks(byte_blocks(spark, sf), path)
    b = fs.read_blocks(spark, path)
    return b.select("source", "split", "block_id", F.size("toks").cast("bigint").alias("n"),
                    ids_string(F.col("toks")).alias("toks"))


@query("a6_build_if_absent")
def a6_build_if_absent(spark, sf):
    path = fs.scratch_path(spark, "built")
    corpus = tables.corpus(spark, sf)

    def build(c):
        return tok.to_blocks(cb.token_segments(c, None, None, short=True))
    # pass 1 builds two sources; pass 2 must only add the missing ones
    first = corpus.filter(F.col("source").isin("en", "de"))
    fs.build_if_absent(first, build, path)
    fs.build_if_absent(corpus, build, path)
    fs.build_if_absent(corpus, build, path)  # nothing left: appends no rows
    b = fs.read_built(spark, path)
    return b.groupBy("source", "split").agg(F.count(F.lit(1)).alias("blocks"),
                                            F.sum(F.size("toks")).cast("bigint").alias("tokens"))


@query("a7_tokenizer_tables")
def a7_tokenizer_tables(spark, sf):
    path = fs.scratch_path(spark, "tokenizer")
    first = fs.ensure_tokenizer(spark, path, lambda: trained_model(spark, sf))   # trains, saves
    again = fs.ensure_tokenizer(spark, path, lambda: BpeModel())                 # loads
    if again.merges != first.merges:
        raise AssertionError("reloaded tokenizer differs from the saved one")
    return again.merges_df(spark)


@query("a8_chat_jsonl")
def a8_chat_jsonl(spark, sf):
    path = fs.scratch_path(spark, "chat")
    fs.write_chat_jsonl(_chat_union(spark, sf), path)
    return fs.read_chat_jsonl(spark, path)


@query("a9_metrics_jsonl")
def a9_metrics_jsonl(spark, sf):
    path = fs.scratch_path(spark, "metrics")
    fs.write_metrics_jsonl(tables.metrics(spark, sf).drop("ts"), path)
    m = fs.metric_columns(fs.read_metrics_jsonl(spark, path), ["val_avg", "val_de"])
    return m.select("run", "step", "ingest_seq", r6(F.col("val_avg")).alias("val_avg"),
                    r6(F.col("val_de")).alias("val_de"))


@query("a9_metrics_long")
def a9_metrics_long(spark, sf):
    """Every series of the logs as files, whatever series a run has: one scan, no schema."""
    path = fs.scratch_path(spark, "metrics")
    fs.write_metrics_jsonl(tables.metrics(spark, sf).drop("ts"), path)
    m = fs.metric_series(fs.read_metrics_jsonl(spark, path))
    return m.select("run", "step", "ingest_seq", "series", r6(F.col("value")).alias("value"))


@query("s2_stream_piece_counts")
def s2_stream_piece_counts(spark, sf):
    base = fs.scratch_path(spark, "pieces")
    stream = _document_files(spark, sf, base)
    st.piece_counts_stream(stream, "lang", tables.LANG_REGISTRY, st.sub(base, "out"),
                           st.sub(base, "ckpt"))
    out = st.latest(spark, st.sub(base, "out"), ["piece"], ["n"])
    return out.select("piece", F.col("n").cast("bigint").alias("n"))


@query("s3_stream_run_best")
def s3_stream_run_best(spark, sf):
    base = fs.scratch_path(spark, "runbest")
    logs = st.sub(base, "logs")
    fs.write_metrics_jsonl(tables.metrics(spark, sf).drop("ts"), logs)
    schema = "run string, val_avg double"
    files = len(spark.read.schema("value string").text(logs).inputFiles())       # a few a scan task
    stream = st.file_stream(spark, logs, T.StructType.fromDDL(schema), fmt="json", files_per_trigger=max(1, -(-files // TRIGGERS)))
    st.run_best_stream(stream, st.sub(base, "out"), st.sub(base, "ckpt"))
    out = st.latest(spark, st.sub(base, "out"), ["run"], ["best_val", "rows"])
    return out.select("run", r6(F.col("best_val")).alias("best_val"),
                      F.col("rows").cast("bigint").alias("rows"))


@query("s2_stream_capped_counts")
def s2_stream_capped_counts(spark, sf):
    """B4 with a limit of documents per source, over files that come in any order."""
    base = fs.scratch_path(spark, "capped")
    stream = _document_files(spark, sf, base)
    st.capped_piece_counts_stream(stream, "lang", tables.LANG_REGISTRY, P.CAP_DOCS, st.sub(base, "out"), st.sub(base, "ckpt"))
    return st.summed(spark, st.sub(base, "out"), ["piece"], "n").select("piece", F.col("n").cast("bigint").alias("n"))


@query("s3_stream_deduped_best")
def s3_stream_deduped_best(spark, sf):
    """G2's final best over G4, as the logs grow."""
    base = fs.scratch_path(spark, "lastwins")
    logs = st.sub(base, "logs")
    fs.write_metrics_jsonl(tables.metrics(spark, sf).drop("ts").repartition(3, "run", "ingest_seq"), logs)
    schema = "run string, step bigint, ingest_seq bigint, val_avg double"
    stream = st.file_stream(spark, logs, T.StructType.fromDDL(schema), fmt="json", files_per_trigger=4)
    st.deduped_best_stream(stream, st.sub(base, "out"), st.sub(base, "ckpt"))
    out = st.latest(spark, st.sub(base, "out"), ["run"], ["best_val", "steps"])
    return out.select("run", r6(F.col("best_val")).alias("best_val"), F.col("steps").cast("bigint").alias("steps"))


@query("e13_completion_extraction")
def e13_completion_extraction(spark, sf):
    """Completions of stored conversations: the response ids without the chat
    prompt, and the plain form with it."""
    pairs = ch.instr_to_chat(tables.instr(spark, sf)).withColumn("source", F.lit("instr"))
    enc = ch.chat_encode(pairs, None)
    chat = ch.completion(enc.select("row_id", F.slice("full", 1, F.col("n_prompt")).alias("prompt"),
                                    F.col("full").alias("out")), True)
    t = pairs.select("row_id", F.col("user").alias("u"), F.concat("user", "assistant").alias("ua"))
    plain = ch.completion(tk.encode(t, None, ["row_id"], text=["u", "ua"], out=["prompt", "out"]), False)
    c = chat.select("row_id", ids_string(F.col("completion")).alias("chat_completion"))
    return c.join(plain.select("row_id", ids_string(F.col("completion")).alias("plain_output")), "row_id")


@query("d10_realised_mix")
def d10_realised_mix(spark, sf):
    b = mx.resolved_bounds(spark, byte_split_lengths(spark, sf), P.MIX, "train", P.SEQ_LEN)
    d = mx.draw_windows(spark, b, P.N_BATCHES * P.BATCH, P.SEQ_LEN, P.BATCH, P.SEED, "train")
    return mx.realised_mix(d, b)


@query("g6_sft_lr_schedule")
def g6_sft_lr_schedule(spark, sf):
    """The instruction-tuning schedule over its real step count:
    epochs * ceil(examples / batch) steps, cosine from the peak to 0."""
    n = _examples(spark, sf).count()                          # one number
    total = P.SFT_EPOCHS * -(-n // P.SFT_BATCH)
    steps = spark.range(total).withColumnRenamed("id", "step")
    lr = mt.sft_lr(F.col("step"), total, P.SFT_LR)
    return steps.select("step", r6(lr * F.lit(1e6)).alias("lr_micro"))
