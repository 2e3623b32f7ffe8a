"""Streams over several files: progress, state carried over triggers, latest values."""
import random

from pyspark.sql import functions as F

from wordloom.operators.tokenizer import training_pieces
from wordloom.sources.corpus import corpus_by_column
from wordloom.sources.files import scratch_path
from wordloom.streaming import ingest as st

REGISTRY = ("en", "de")
DOC = "doc_id long, lang string, text string"


def _folder(spark, rows, name, n=4):
    path = scratch_path(spark, name)
    for i in range(n):
        spark.createDataFrame(rows[i::n], DOC).coalesce(1).write.mode("append").parquet(path)
    return path


def test_piece_counts_over_triggers(spark):
    rows = [(i, "en" if i % 3 else "de", f"word{i % 5} and  more {i}") for i in range(40)] + [(99, None, "no source"), (100, "en", " ")]
    path, out = _folder(spark, rows, "t-s2"), scratch_path(spark, "t-s2-out")
    schema = spark.read.parquet(path).schema
    st.piece_counts_stream(st.file_stream(spark, path, schema, files_per_trigger=1), "lang", REGISTRY, out, out + "-ckpt")
    assert spark.read.parquet(out).select("epoch").distinct().count() >= 3
    got = {r.piece: r.n for r in st.latest(spark, out, ["piece"], ["n"]).collect()}
    batch = training_pieces(corpus_by_column(spark.read.parquet(path), "lang", REGISTRY))
    assert got == {r.piece: r.n for r in batch.collect()}
    # new files only add to the state; nothing is read twice
    spark.createDataFrame([(200, "en", "word1 again")], DOC).coalesce(1).write.mode("append").parquet(path)
    st.piece_counts_stream(st.file_stream(spark, path, schema, files_per_trigger=1), "lang", REGISTRY, out, out + "-ckpt")
    again = {r.piece: r.n for r in st.latest(spark, out, ["piece"], ["n"]).collect()}
    assert again["word"] == got["word"] + 1 and again[" and"] == got[" and"]


def test_ingest_over_triggers(spark):
    rows = [(i, "en", f"text {i}") for i in range(20)] + [(50, "en", ""), (51, "en", None)]
    path, out = _folder(spark, rows, "t-s1"), scratch_path(spark, "t-s1-out")
    st.ingest_corpus(st.file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1), "lang", REGISTRY,
                     out, out + "-ckpt")
    assert spark.read.parquet(out).count() == 20
    assert spark.read.parquet(out).select(F.countDistinct("doc_id")).first()[0] == 20


def test_capped_counts_retract_pushed_out_documents(spark):
    """Files come in any order: a later file's smaller ids push out documents counted before."""
    r = random.Random(4)
    rows = [(r.choice([None, *range(60)]), r.choice(["en", "de", None]), f"w{r.randrange(6)} x{r.randrange(9)}") for _ in range(120)]
    rows += [(7, "en", "same text")] * 3 + [(500, "en", " "), (0, "de", None)]
    rows.sort(key=lambda x: -(x[0] or 0))                     # the smallest ids come last
    path, out = scratch_path(spark, "t-cap"), scratch_path(spark, "t-cap-out")
    for i in range(5):
        spark.createDataFrame(rows[i * 25:(i + 1) * 25], DOC).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    for n in (12,):
        st.capped_piece_counts_stream(st.file_stream(spark, path, schema, files_per_trigger=1), "lang", REGISTRY, n, out, out + "-ckpt")
        got = {r.piece: r.n for r in st.summed(spark, out, ["piece"], "n").collect()}
        batch = training_pieces(corpus_by_column(spark.read.parquet(path), "lang", REGISTRY), n)
        assert got == {r.piece: r.n for r in batch.collect()}
    assert spark.read.parquet(out).filter("n < 0").count() > 0
    spark.createDataFrame([(-1, "en", "brand new")], DOC).coalesce(1).write.mode("append").parquet(path)
    st.capped_piece_counts_stream(st.file_stream(spark, path, schema, files_per_trigger=1), "lang", REGISTRY, 12, out, out + "-ckpt")
    batch = training_pieces(corpus_by_column(spark.read.parquet(path), "lang", REGISTRY), 12)
    assert {r.piece: r.n for r in st.summed(spark, out, ["piece"], "n").collect()} == {r.piece: r.n for r in batch.collect()}


def test_best_after_resume_forgets_replaced_rows(spark):
    """The best value is logged, then its step is logged again with a worse one."""
    from wordloom.operators.metrics import dedup_resumed, running_best
    schema = "run string, step long, ingest_seq long, val_avg double"
    parts = [[("r", 1, 1, 5.0), ("r", 2, 2, 1.0), ("q", 1, 1, 3.0)], [("r", 2, 3, 4.0), ("q", 2, 2, None)], [("r", 1, 0, 0.5), ("r", 3, 4, 4.5)]]
    path, out = scratch_path(spark, "t-best"), scratch_path(spark, "t-best-out")
    seen = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        st.deduped_best_stream(st.file_stream(spark, path, spark.read.parquet(path).schema), out, out + "-ckpt")
        got = {r.run: (r.best_val, r.steps) for r in st.latest(spark, out, ["run"], ["best_val", "steps"]).collect()}
        log = dedup_resumed(spark.read.parquet(path))
        want = {r.run: (r.best, r.n) for r in log.groupBy("run").agg(F.min("val_avg").alias("best"), F.count("*").alias("n")).collect()}
        assert got == want
        best = {r.run: r.val_avg for r in running_best(log).filter("is_best and val_avg is not null").orderBy("run", "step").collect()}
        assert {k: v[0] for k, v in got.items()} == best
        seen.append(got["r"][0])
    assert seen == [1.0, 4.0, 4.0]


def test_run_logs_with_disjoint_keys(spark):
    """Runs log different series, one starts a new one half-way; blank and broken lines are skipped."""
    import os
    from wordloom.sources.files import metric_columns, metric_series, read_metrics_jsonl
    path = scratch_path(spark, "t-logs")
    logs = {"a": ['{"step": 1, "ingest_seq": 1, "train_loss": 2.5, "val_en": 1}', "", '{"step": 2, "ingest_seq": 2, "val_en": 0.5, "val_new": 7.25}'],
            "b": ['{"step": 1, "ingest_seq": 9, "val_fr": 3.0, "lr": 0.1, "note": "x"}', "not json", '{"step": 3, "ingest_seq": 10, "val_fr": null}']}
    for run, lines in logs.items():
        os.makedirs(f"{path.removeprefix('file:')}/run={run}")
        with open(f"{path.removeprefix('file:')}/run={run}/log.jsonl", "w") as f:
            f.write("\n".join(lines))
    rows = read_metrics_jsonl(spark, path)
    assert sorted(tuple(r) for r in metric_series(rows).collect()) == [
        ("a", 1, 1, "train_loss", 2.5), ("a", 1, 1, "val_en", 1.0), ("a", 2, 2, "val_en", 0.5), ("a", 2, 2, "val_new", 7.25),
        ("b", 1, 9, "val_fr", 3.0)]
    wide = metric_columns(rows, ["val_en", "val_fr"]).orderBy("run", "step").collect()
    assert [tuple(r) for r in wide] == [("a", 1, 1, 1.0, None), ("a", 2, 2, 0.5, None), ("b", 1, 9, None, 3.0), ("b", 3, 10, None, None)]
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
