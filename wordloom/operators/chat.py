"""Instruction sets (E1-E14): Q&A tables -> chat pairs -> masked, padded batches."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import hash_key, rank_by_hash, ranked_rows
from ..functions.text import (ASSISTANT_ID, BYTE_OFFSET, EOT_ID, PAD_ID, USER_ID, capitalize,
                              py_strip, r6, truthy)
from ..session import stored
from .bpe import BpeModel
from .tokenizer import encode

# Answer letters (fixed values).
LETTERS = ("A", "B", "C", "D")
MIN_TOKENS = 4     # E9: shorter examples are dropped
IGNORE = -1        # label of a masked position


def _opts() -> list[Column]:
    return [F.col(c) for c in ("opa", "opb", "opc", "opd")]


def mcq_valid(df: DataFrame) -> DataFrame:
    """Rows with all four options truthy and ``cop`` in 0..3."""
    cond = F.col("cop").isNotNull() & F.col("cop").between(0, 3)
    for o in _opts():
        cond = cond & truthy(o)
    return df.filter(cond)


def mcq_to_chat(df: DataFrame) -> DataFrame:
    """``question`` + lettered options -> "The correct answer is L. opt." (+ explanation)."""
    v = mcq_valid(df)
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{L}. "), o) for L, o in zip(LETTERS, _opts())])
    user = F.concat(py_strip("question"), F.lit("\n"), body)
    pick = F.col("cop") + 1
    ans = F.concat(F.lit("The correct answer is "),
                   F.element_at(F.array(*[F.lit(L) for L in LETTERS]), pick), F.lit(". "),
                   F.element_at(F.array(*_opts()), pick), F.lit("."))
    ans = F.when(truthy("exp"), F.concat(ans, F.lit(" "), py_strip("exp"))).otherwise(ans)
    return v.select("row_id", user.alias("user"), ans.alias("assistant"))


def qa_to_chat(df: DataFrame) -> DataFrame:
    """Drop rows whose stripped question or long answer is empty;
    assistant = "Decision. long" (decision capitalised) or just the long answer."""
    q = py_strip(F.coalesce(F.col("question"), F.lit("")))
    dec = py_strip(F.coalesce(F.col("final_decision"), F.lit("")))
    long = py_strip(F.coalesce(F.col("long_answer"), F.lit("")))
    t = df.select("row_id", q.alias("q"), dec.alias("dec"), long.alias("long"))
    t = t.filter((F.col("q") != "") & (F.col("long") != ""))
    ans = F.when(F.col("dec") != "", F.concat(capitalize("dec"), F.lit(". "), F.col("long"))) \
        .otherwise(F.col("long"))
    return t.select("row_id", F.col("q").alias("user"), ans.alias("assistant"))


def instr_to_chat(df: DataFrame) -> DataFrame:
    """Drop rows with empty instruction or output; the input, when present,
    goes on a second line of the user turn."""
    ins = py_strip(F.coalesce(F.col("instruction"), F.lit("")))
    inp = py_strip(F.coalesce(F.col("input"), F.lit("")))
    out = py_strip(F.coalesce(F.col("output"), F.lit("")))
    t = df.select("row_id", ins.alias("ins"), inp.alias("inp"), out.alias("out"))
    t = t.filter((F.col("ins") != "") & (F.col("out") != ""))
    user = F.when(F.col("inp") != "", F.concat(F.col("ins"), F.lit("\n"), F.col("inp"))) \
        .otherwise(F.col("ins"))
    return t.select("row_id", user.alias("user"), F.col("out").alias("assistant"))


def quota_union(pairs: Mapping[str, tuple[DataFrame, int | None]]) -> DataFrame:
    """E4 + E5: first ``n`` valid rows of each source (by ``row_id``), then the
    bag union with a ``source`` column. Only keys are ranked."""
    out = None
    for name, (df, n) in pairs.items():
        t = df.withColumn("source", F.lit(name))
        out = t if out is None else out.unionByName(t)
    quotas = {k: n for k, (_, n) in pairs.items() if n}
    if not quotas:
        return out
    limit = F.lit(None).cast("bigint")
    for k, n in quotas.items():
        limit = F.when(F.col("source") == k, F.lit(n)).otherwise(limit)
    limit = F.coalesce(limit, F.lit((1 << 63) - 1))
    return ranked_rows(stored(out, "chat-pairs"), ["source"], "row_id", "__rank", limit).drop("__rank")


def seeded_shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """A deterministic permutation: ``position`` = rank of md5(seed:source:row_id)."""
    df = stored(df, "examples")
    k = df.select("source", "row_id").withColumn("__key", hash_key(F.lit(seed), F.col("source"), F.col("row_id")))
    return df.join(rank_by_hash(k, "__key", out="position").drop("__key"), ["source", "row_id"])


def _chat_arrays(prompt_ids: Column, resp_ids: Column) -> tuple[Column, Column]:
    prompt = F.concat(F.array(F.lit(USER_ID)), prompt_ids, F.array(F.lit(ASSISTANT_ID)))
    resp = F.concat(resp_ids, F.array(F.lit(EOT_ID)))
    return prompt, resp


def chat_encode(df: DataFrame, model: BpeModel | None) -> DataFrame:
    """prompt = [user] + enc("\n" + user) + [assistant];
    response = enc("\n" + assistant) + [eot]; labels mask the prompt with -1.

    Both texts are encoded in one pass."""
    keys = ["source", "row_id"]
    t = df.select(*keys, F.concat(F.lit("\n"), F.col("user")).alias("u"),
                  F.concat(F.lit("\n"), F.col("assistant")).alias("a"))
    if model is None or not model.merges:
        from ..functions.text import byte_ids
        j = t.select(*keys, byte_ids(F.col("u")).alias("eu"), byte_ids(F.col("a")).alias("ea"))
    else:
        j = encode(t, model, keys, text=["u", "a"], out=["eu", "ea"])
    prompt, resp = _chat_arrays(F.col("eu"), F.col("ea"))
    j = j.select(*keys, prompt.alias("prompt"), resp.alias("resp"))
    return j.select(*keys, F.size("prompt").alias("n_prompt"),
                    F.concat("prompt", "resp").alias("full"),
                    F.concat(F.array_repeat(F.lit(IGNORE), F.size("prompt")), F.col("resp"))
                    .alias("labels"))


def truncate_examples(df: DataFrame, max_len: int) -> DataFrame:
    """E8 + E9: ids and labels cut together to ``max_len``; examples shorter than
    four tokens are dropped; ``n_target`` counts the trainable labels (0 when
    the prompt fills the window - such rows are kept, as in the reference)."""
    t = df.select("source", "row_id", "n_prompt",
                  F.slice("full", 1, max_len).alias("full"),
                  F.slice("labels", 1, max_len).alias("labels"))
    t = t.filter(F.size("full") >= MIN_TOKENS)
    # labels are -1 exactly on the (kept part of the) prompt
    return t.withColumn("n_target", F.size("labels") - F.least(F.col("n_prompt"), F.size("labels")))


def epoch_batches(df: DataFrame, epochs: int, batch_size: int, seed: int = 0) -> DataFrame:
    """Every epoch is its own permutation (md5(seed:epoch:source:row_id));
    consecutive slices of ``batch_size`` form batches, the last one partial.
    ``epochs`` is a parameter, so the epoch frame is parameter-sized."""
    df = stored(df, "examples")
    j = df.select("source", "row_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    k = j.withColumn("__key", hash_key(F.lit(seed), F.col("epoch"), F.col("source"),
                                       F.col("row_id")))
    r = rank_by_hash(k, "__key", part=["epoch"], out="rank").drop("__key")
    r = r.join(df, ["source", "row_id"])                 # only keys are ranked
    return r.withColumn("batch_id", (F.col("rank") / batch_size).cast("bigint")) \
            .withColumn("row", (F.col("rank") % batch_size).cast("int"))


def collate(batches: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Pad to the batch's longest example: x = full[:-1] + pad,
    y = labels[1:] + -1; both of width (batch max - 1)."""
    w = Window.partitionBy("epoch", "batch_id")  # a batch is batch_size rows
    t = batches.withColumn("__m", F.max(F.size("full")).over(w))
    pad = F.col("__m") - F.size("full")
    x = F.concat(F.slice("full", 1, F.size("full") - 1), F.array_repeat(F.lit(pad_id), pad))
    y = F.concat(F.slice("labels", 2, F.size("labels") - 1), F.array_repeat(F.lit(IGNORE), pad))
    # y is -1 on the prompt minus its first position (dropped by the shift) and on the pad
    masked = F.greatest(F.least(F.col("n_prompt"), F.size("labels")) - 1, F.lit(0)) + pad
    return t.select("epoch", "batch_id", "row", "source", "row_id", x.alias("x"), y.alias("y"),
                    pad.cast("int").alias("n_pad"), masked.cast("int").alias("n_masked"))


def padding_report(batches: DataFrame) -> DataFrame:
    """Share of pad and of masked target positions per epoch, from the examples' lengths:
    a batch of ``n`` rows whose longest has ``m`` tokens has ``n (m - 1)`` positions."""
    masked = F.greatest(F.least(F.col("n_prompt"), F.size("labels")) - 1, F.lit(0))
    b = batches.groupBy("epoch", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("full")).alias("m"), F.sum(F.size("full")).alias("tokens"),
        F.sum(masked).alias("prompt"))
    pad = F.col("n") * F.col("m") - F.col("tokens")
    total = lambda c: F.sum(c).cast("bigint")
    return b.groupBy("epoch").agg(
        total(F.col("n")).alias("rows"), F.count(F.lit(1)).alias("batches"),
        total(F.col("n") * (F.col("m") - 1)).alias("positions"), total(pad).alias("pad"),
        total(F.col("prompt") + pad).alias("masked")) \
        .withColumn("pad_share", r6(F.col("pad") / F.col("positions"))) \
        .withColumn("masked_share", r6(F.col("masked") / F.col("positions")))


def inference_prompts(df: DataFrame, model: BpeModel | None, text: str = "text",
                      key: str = "item_id") -> DataFrame:
    """Chat form [user] + enc("\\n"+p) + [assistant] + enc("\\n"), and plain enc(p).
    A single byte never merges, so enc("\\n") is the newline's byte id."""
    t = df.select(key, F.concat(F.lit("\n"), F.col(text)).alias("u"), F.col(text).alias("p"))
    if model is None or not model.merges:
        from ..functions.text import byte_ids
        j = t.select(key, byte_ids(F.col("u")).alias("eu"), byte_ids(F.col("p")).alias("plain"))
    else:
        j = encode(t, model, [key], text=["u", "p"], out=["eu", "plain"])
    chat = F.concat(F.array(F.lit(USER_ID)), F.col("eu"), F.array(F.lit(ASSISTANT_ID)),
                    F.array(F.lit(BYTE_OFFSET + 10)))
    return j.select(key, chat.alias("chat"), "plain")


def completion(df: DataFrame, chat: bool, prompt: str = "prompt", out: str = "out") -> DataFrame:
    """Generated ids without the prompt prefix (chat) or with it (plain)."""
    if not chat:
        return df.withColumn("completion", F.col(out))
    return df.withColumn("completion", F.slice(F.col(out), F.size(prompt) + 1,
                                                F.greatest(F.size(out) - F.size(prompt), F.lit(0))))
