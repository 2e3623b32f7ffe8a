"""Mixing loader edges: fallback, drops, window content."""
import pytest
from pyspark.sql import functions as F

from wordloom.operators import mixing as mx


def _blocks(spark, spec, block=4):
    """spec: {(source, split): n_tokens}; token value = 1000*k + position."""
    rows = []
    for k, ((src, split), n) in enumerate(sorted(spec.items())):
        toks = [1000 * k + i for i in range(n)]
        for b in range(0, n, block):
            rows.append((src, split, b // block, toks[b:b + block]))
    return spark.createDataFrame(rows, "source string, split string, block_id long, toks array<int>"), spec


def test_resolution_fallback_and_drops(spark):
    seq = 4
    blocks, _ = _blocks(spark, {("a", "train"): 20, ("a", "val"): 8, ("b", "train"): 9,
                                ("c", "train"): 5, ("d", "train"): 6})
    res = {r.source: r for r in mx.resolve_mix(
        mx.mix_frame(spark, {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1}),
        mx.split_lengths(blocks), "val", seq).collect()}
    assert res["a"].read_split == "val" and not res["a"].fell_back and res["a"].drop_reason is None
    assert res["b"].read_split == "train" and res["b"].fell_back       # only train present
    assert res["c"].drop_reason == "too short"                          # n = seq + 1
    assert res["d"].drop_reason is None                                 # n = seq + 2 is usable
    assert res["e"].drop_reason == "no data"


def test_no_usable_source_raises(spark):
    blocks, _ = _blocks(spark, {("a", "train"): 3})
    with pytest.raises(RuntimeError):
        mx.mixed_batches(spark, blocks, {"a": 1.0}, 4, 2, 1)


def test_windows_are_flat_slices(spark):
    seq = 5
    blocks, spec = _blocks(spark, {("a", "train"): 37, ("b", "train"): 23}, block=4)
    w = mx.mixed_batches(spark, blocks, {"a": 0.7, "b": 0.3}, seq, 4, 25, seed=3, block=4).collect()
    assert len(w) == 100
    flat = {src: [1000 * k + i for i in range(n)] for k, ((src, _), n) in enumerate(sorted(spec.items()))}
    for r in w:
        n = len(flat[r.source])
        assert 0 <= r.start < n - seq - 1                               # upper bound exclusive
        assert list(r.x) == flat[r.source][r.start:r.start + seq]
        assert list(r.y) == flat[r.source][r.start + 1:r.start + seq + 1]
    assert {r.source for r in w} == {"a", "b"}


def test_draws_do_not_depend_on_partitioning(spark):
    blocks, _ = _blocks(spark, {("a", "train"): 50, ("b", "train"): 50})
    b = mx.resolved_bounds(spark, mx.split_lengths(blocks), {"a": 1, "b": 2}, "train", 4)
    one = mx.draw_windows(spark, b, 200, 4, 8, 1337, "train").orderBy("i").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = mx.draw_windows(spark, b.repartition(2), 200, 4, 8, 1337, "train").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == two
    # val draws use a different seed
    v = mx.draw_windows(spark, b, 200, 4, 8, 1337, "val").orderBy("i").collect()
    assert [r.start for r in v] != [r.start for r in one]


def test_bounds_leave_no_gap(spark):
    """For any number of equal weights, one bound starts where the last one ends."""
    for n in (3, 7, 11, 39):
        lengths = spark.createDataFrame([(f"s{i}", "train", 99) for i in range(n)], "source string, split string, n long")
        mix = mx.mix_frame(spark, {f"s{i}": 0.1 for i in range(n)})
        b = mx.mix_bounds(mx.resolve_mix(mix, lengths, "train", 4)).orderBy("ord").collect()
        assert b[0].lo == 0.0 and b[-1].hi == 1.0
        assert all(x.hi == y.lo for x, y in zip(b, b[1:]))


def test_starts_of_a_large_source_are_spread(spark):
    """2^45 tokens: the starts fall on far more residues than 32-bit draws could reach."""
    b = spark.createDataFrame([("a", "train", 1 << 45, 0.0, 1.0)], "source string, read_split string, n long, lo double, hi double")
    d = mx.draw_windows(spark, b, 2000, 128, 8, 1, "train").select((F.col("start") % 8192).alias("r")).distinct().count()
    assert d > 1700


def test_loader_reads_only_its_partitions(spark):
    from wordloom.sources.files import read_blocks, scratch_path, write_blocks
    blocks, _ = _blocks(spark, {("a", "train"): 40, ("a", "val"): 9, ("b", "train"): 40})
    path = scratch_path(spark, "t-blocks")
    write_blocks(blocks, path)
    stored = read_blocks(spark, path).filter("source = 'a' and split = 'val'")
    assert "PartitionFilters: [isnotnull(source" in stored._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 3


def test_window_read_leaves_stored_blocks_in_place(spark):
    """The plan for two million windows: nothing is exchanged above the block scan."""
    from wordloom.operators import mixing as mx
    from wordloom.sources.files import scratch_path, store_buckets
    segs = spark.createDataFrame([(s, sp, i, 5000 * i, 5000, list(range(5000))) for s in ("a", "b") for sp in ("train", "val") for i in range(4)],
                                 "source string, split string, doc_id long, pos long, len long, ids array<int>")
    blocks = store_buckets(segs, scratch_path(spark, "blocks"))
    n = spark.range(2_000_000)
    draws = n.selectExpr("id as i", "id div 8 as batch_id", "cast(id % 8 as int) as seq_in_batch",
                         "if(id % 2 = 0, 'a', 'b') as source", "if(id >= 0, 'train', 'val') as split", "(id * 37) % 19000 as start")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)         # this test's few blocks would be broadcast
    try:
        _check_plan(mx.read_windows(draws, blocks, 128))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = mx.read_windows(draws.filter("i < 200"), blocks, 128).collect()
    assert len(few) == 200 and all(r.x == [(r.start + k) % 5000 for k in range(128)] for r in few)


def _check_plan(windows):
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above = [x for i, x in enumerate(lines[join:scan], join) if all(depth(x) < depth(y) for y in lines[i + 1:scan + 1])]
    assert not any("Exchange" in x for x in above if depth(x) > depth(lines[join]))


def test_another_session_reads_the_buckets(spark):
    from wordloom.sources.files import _block_table, read_buckets, scratch_path, store_buckets
    segs = spark.createDataFrame([("a", "train", 0, 0, 9000, [7] * 9000)],
                                 "source string, split string, doc_id long, pos long, len long, ids array<int>")
    path = scratch_path(spark, "blocks")
    store_buckets(segs, path, buckets=5)
    spark.sql(f"drop table {_block_table(path)}")
    again = read_buckets(spark, path)
    assert sorted((r.block_id, len(r.toks)) for r in again.collect()) == [(0, 4096), (1, 4096), (2, 808)]
    assert "SelectedBucketsCount: 5 out of 5" in again.groupBy("source", "split", "block_id").count()._jdf.queryExecution().executedPlan().toString()
