"""The registered queries of this package, one per operator, and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, katz, mixing, neighbours, ranked_search, repeats, secrets, similarity, surrogates, token_rollup, toxicity, url_reputation
from .oracle import ORACLE
from .shared import materialize, shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return toxicity.score(docs, net, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(_table(spark, sf_dir, "pages"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_table(spark, sf_dir, "documents"))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.join(_table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.anonymize(_table(spark, sf_dir, "documents"), surrogates.session_key(spark))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


WORDS_1, WORDS_2, BPE = "words-1", "words-2", "byte-bpe-50k"
WORDS_2_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches over ``documents``: load under two tokenizer versions, delete exact copies
    of earlier documents, move the word counts of the rest to a revised tokenizer, and replay
    the first load, which changes nothing."""
    docs = _table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"),
                       token_rollup.word_counts(mixing.WORD).alias("w1"),
                       token_rollup.word_counts(WORDS_2_PATTERN).alias("w2"))
    counts = materialize(token_rollup.bpe_counts(slim, ["doc_id", "source", "lang", "sha", "w1", "w2"]), "token-counts")
    firsts = counts.groupBy("sha").agg(F.min("doc_id").alias("first"))
    kept = materialize(counts.join(firsts, "sha").withColumn(
        "copy", F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False))).drop("sha", "first"), "token-kept")

    def under(df: DataFrame, version: str, col: str) -> DataFrame:
        return df.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.col(col).alias("n_tokens"))

    state = token_rollup.TokenRollup(spark, shared_path(spark, "token-rollup"))
    load = token_rollup.signed(under(kept, WORDS_1, "w1"), 1)
    state.commit("001-load-words", load)
    state.commit("002-load-bpe", token_rollup.signed(under(kept, BPE, "n_tokens"), 1))
    copies, rest = kept.filter("copy"), kept.filter("not copy")
    state.commit("003-drop-copies", token_rollup.signed(
        under(copies, WORDS_1, "w1").unionByName(under(copies, BPE, "n_tokens")), -1))
    state.commit("004-recount-words", token_rollup.revised(under(rest, WORDS_1, "w1"), under(rest, WORDS_2, "w2")))
    state.commit("001-load-words", load)
    return state.totals()


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of one ledger: the first reads every blob, the second finds all pairs scanned
    and only joins the findings back to the paths."""
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.BlobLedger(spark, shared_path(spark, "blob-ledger"))
    ledger.scan(docs, ["doc_id"])
    return secrets.secret_report(docs, ledger)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def registry() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontaminate": op2_decontaminate,
        "op3_mix": op3_mix,
        "op4_url_reputation": op4_url_reputation,
        "op5_suffix_array": op5_suffix_array,
        "op6_chosen_path_join": op6_chosen_path_join,
        "op7_surrogates": op7_surrogates,
        "op8_neighbours": op8_neighbours,
        "op9_token_rollup": op9_token_rollup,
        "op10_secret_ledger": op10_secret_ledger,
        "op11_filter_audit": op11_filter_audit,
        "op12_ranked_search": op12_ranked_search,
        "op13_katz": op13_katz,
    }


def oracle() -> dict[str, str]:
    return dict(ORACLE)
