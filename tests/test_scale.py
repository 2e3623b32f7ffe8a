"""What must not grow with the tables: work of one task, triggers of a stream, rows a token."""
from pyspark.sql import functions as F

from wordloom.operators import evaluation as ev
from wordloom.plans import catalog, oracle, params as P
from wordloom.sources import files as fs


def _table(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def _triggers(spark, out):
    return spark.read.parquet(out).select("epoch").distinct().count()


def test_audit_covers_reserved_specials_of_the_learned_table(spark, monkeypatch):
    """Every reserved special, called for or not, against the vocabulary learned from the documents."""
    folder = fs.scratch_path(spark, "t-b12")
    _table(spark.createDataFrame([(1, "en", "the cat the hat"), (2, "de", "das die der")], "doc_id long, lang string, text string"), folder, "documents")
    _table(spark.createDataFrame([("user",), ("tool",), (None,)], "role string"), folder, "conversations")
    monkeypatch.setattr(P, "VOCAB", 270)
    saved = []
    monkeypatch.setattr(fs, "save_tokenizer", lambda s, m, p, f=fs.save_tokenizer: (saved.append(m), f(s, m, p)))
    got = {r.text: (r.declared, r.id, r.resolved) for r in catalog.registry()["b12_special_audit"](spark, folder).collect()}
    assert saved[0].merges
    assert got == {"<|endoftext|>": (0, 0, True), "<|pad|>": (1, 1, True), "<|system|>": (2, 2, True), "<|user|>": (3, 3, True),
                   "<|assistant|>": (4, 4, True), "<|tool|>": (None, None, False)}
    assert "documents" in oracle.oracle()["b12_special_audit"]


def test_document_streams_write_more_files_not_larger_ones(spark):
    folder, base = fs.scratch_path(spark, "t-files"), fs.scratch_path(spark, "t-files-out")
    rows = spark.range(400, numPartitions=10).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("some text").alias("text"))
    _table(rows, folder, "documents")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)           # a split a file, as of a large table
    try:
        catalog._document_files(spark, folder, base)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    written = spark.read.parquet(f"{base}/files")
    assert len(written.inputFiles()) >= 10 and written.count() == 400


def test_run_best_triggers_do_not_grow_with_the_files(spark, monkeypatch):
    folder = fs.scratch_path(spark, "t-s3")
    rows = spark.range(240, numPartitions=12).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.concat(F.lit("run"), F.col("id") % 2).alias("event_type"), (F.col("id") + 1.0).alias("value"))
    _table(rows, folder, "events")
    seen = []
    monkeypatch.setattr(catalog.st, "latest", lambda s, out, *a, f=catalog.st.latest: (seen.append(_triggers(s, out)), f(s, out, *a))[1])
    monkeypatch.setattr(catalog.tables, "metrics", lambda s, sf, f=catalog.tables.metrics: f(s, sf).repartition(12))
    got = {r.run: (r.best_val, r.rows) for r in catalog.registry()["s3_stream_run_best"](spark, folder).collect()}
    assert got == {"run0": (1.125, 120), "run1": (2.25, 120)} and seen[0] <= catalog.TRIGGERS


def test_token_counts_leave_blocks_summed(spark, monkeypatch):
    """Counts of pairs and suffixes over blocks, empty ones and boundaries included, as Python counts them."""
    from collections import Counter
    monkeypatch.setattr(ev, "BLOCKS_AT_ONCE", 2)
    toks = {"a": [[5, 6, 5, 6, 7], [5, 6, 5, 5, 5], [6, 6]], "b": [[7, 7, 7, 7, 7], [260]], "c": [[9]]}
    rows = [(s, "train", i, b) for s, bs in toks.items() for i, b in enumerate(bs)] + [("a", "val", 0, [1, 2, 3])]
    df = spark.createDataFrame(rows, "source string, split string, block_id bigint, toks array<int>")
    pairs, suffixes = Counter(), Counter()
    for bs in toks.values():
        arr = [t for b in bs for t in b]
        pairs.update(zip(arr, arr[1:]))
        for i, w in enumerate(arr):
            p = [arr[i - k] if i >= k else -1 for k in (1, 2, 3)]
            suffixes[sum(x + 1 << 17 * k for k, x in enumerate(p)), w] += 1
    big, suf = ev.bigram_counts(df), ev.suffix_counts(df)
    assert {(r.v, r.w): r.c for r in big.collect()} == pairs
    assert {(r.ctx, r.w): r.c for r in suf.collect()} == suffixes
    for x in (big, suf):
        assert "Generate explode" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_absent_sources_are_found_without_a_shuffle(spark, monkeypatch):
    """The corpus is not dealt by source, whose largest would be one task."""
    from wordloom.operators import tokens as tok
    path = fs.scratch_path(spark, "t-a6")
    corpus = spark.createDataFrame([("en", 1, "a"), (None, 2, "b"), ("de", 3, "c")], "source string, doc_id bigint, text string")
    plans = []

    def build(c):
        plans.append(c._jdf.queryExecution().executedPlan().toString())
        return tok.to_blocks(c.select("source", F.lit("train").alias("split"), F.lit(0).cast("bigint").alias("pos"),
                                      F.lit(1).cast("bigint").alias("len"), F.array(F.ascii("text")).alias("ids")))

    fs.build_if_absent(corpus.filter("source = 'en'"), build, path)
    fs.build_if_absent(corpus, build, path)
    fs.build_if_absent(corpus, build, path)
    assert len(plans) == 2 and all("+- BroadcastHashJoin" in p.splitlines()[1] for p in plans)
    assert sorted((r.source or "", list(r.toks)) for r in fs.read_built(spark, path).collect()) == [("", [98]), ("de", [99]), ("en", [97])]


def test_blocks_are_dealt_as_16_bit_ids(spark):
    from wordloom.plans import corpus_build as cb
    corpus = spark.createDataFrame([("en", 0, 1, "abé"), ("en", 0, 2, "c")], "source string, ord int, doc_id bigint, text string")
    segs = cb.token_segments(corpus, None, None, short=True)
    assert segs.schema["ids"].dataType.simpleString() == "array<smallint>"
    blocks = catalog.tok.to_blocks(segs)
    assert blocks.schema["toks"].dataType.simpleString() == "array<int>"
    assert [list(r.toks) for r in blocks.collect()] == [[102, 103, 200, 174, 0, 104, 0]]


def test_distinct_rows_of_any_width():
    import numpy as np
    from collections import Counter
    rng = np.random.default_rng(1)
    for high, n in ((3, 500), (1 << 16, 500), (1 << 17, 1), (5, 0), (1, 9)):
        columns = [rng.integers(0, high, n) for _ in range(4)]
        columns[2][n // 2:] = 0
        columns = [np.concatenate([c, c]) for c in columns]
        got, count = ev._distinct(*columns)
        assert dict(zip(zip(*(x.tolist() for x in got)), count.tolist())) == Counter(zip(*(c.tolist() for c in columns)))
