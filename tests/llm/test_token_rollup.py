import pytest
from pyspark.sql import functions as F

from wordloom.llm import token_rollup as T
from wordloom.llm.shared import shared_path

COUNTS = "source string, lang string, tokenizer_version string, n_tokens long"


def totals(state):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in state.totals().collect()}


def test_batches(spark):
    state = T.TokenRollup(spark, shared_path(spark, "t-rollup"))
    assert totals(state) == {}
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, "en", "v1", 2), ("b", None, "v1", 0)], COUNTS)
    assert state.commit("1", T.signed(rows, 1))
    first = {("a", "en", "v1"): (2, 12), (None, "en", "v1"): (1, 2), ("b", None, "v1"): (1, 0)}
    assert totals(state) == first
    assert not state.commit("1", T.signed(rows, 1)) and totals(state) == first          # replay
    gone = spark.createDataFrame([("a", "en", "v1", 7)], COUNTS)
    assert state.commit("2", T.signed(gone, -1))
    old, new = (spark.createDataFrame([("a", "en", v, n)], COUNTS) for v, n in (("v1", 5), ("v2", 9)))
    assert state.commit("3", T.revised(old, new))
    assert totals(state) == {("a", "en", "v2"): (1, 9), (None, "en", "v1"): (1, 2), ("b", None, "v1"): (1, 0)}
    assert state.commit("4", T.signed(rows.limit(0), 1)) and len(totals(state)) == 3    # an empty batch
    with pytest.raises(ValueError):
        state.commit("a/b", rows)


def test_unfinished_batch_is_redone(spark):
    path = shared_path(spark, "t-cut")
    rows = spark.createDataFrame([("a", "en", "v1", 5)], COUNTS)
    T.signed(rows, 1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch-1")
    state = T.TokenRollup(spark, path)
    assert totals(state) == {}
    assert state.commit("1", T.signed(rows, 1)) and totals(state) == {("a", "en", "v1"): (1, 5)}


def test_bpe_counts(spark, odd, odd_rows):
    import tiktoken
    import base64
    from wordloom.functions.text import PIECE_PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.RANKS_PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(r["n_tokens"] for r in T.bpe_counts(odd, ["doc_id", "size"]).collect())
    assert got == sorted(len(enc.encode_ordinary(r[1] or "")) for r in odd_rows)


def test_query_against_direct_counts(spark):
    """The query's deltas add up to a direct count over the documents that stay."""
    from wordloom.llm import queries as Q
    sf = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"])
           for r in Q.op9_token_rollup(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rest = docs.join(first, "doc_id").withColumn("w2", T.word_counts(Q.WORDS_2_PATTERN))
    bpe = T.bpe_counts(rest, ["source", "lang", "w2"]).collect()
    want = {}
    for r in bpe:
        for v, n in ((Q.WORDS_2, r["w2"]), (Q.BPE, r["n_tokens"])):
            d, t = want.get((r["source"], r["lang"], v), (0, 0))
            want[(r["source"], r["lang"], v)] = (d + 1, t + n)
    assert got == want
