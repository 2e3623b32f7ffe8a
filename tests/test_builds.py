"""Only committed builds count; C4/C6: a build reports its own write and fails on bad ids."""
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wordloom.operators.tokens import guarded, to_blocks
from wordloom.plans.corpus_build import stored_blocks, token_segments
from wordloom.sources import files as fs


def corpus(spark):
    rows = [(s, o, i, f"{s} text {i} " * (i + 1)) for o, s in enumerate(("en", "de", None)) for i in range(30)]
    return spark.createDataFrame(rows, "source string, ord int, doc_id long, text string")


def build(c):
    return to_blocks(token_segments(c, None, None), block=512)


def rows(df):
    return sorted(((str(r.source), r.split, r.block_id, tuple(r.toks)) for r in df.collect()))


def test_killed_build_is_rebuilt(spark):
    """A build that dies after half its files leaves nothing that readers see or the next call skips."""
    c, path = corpus(spark), fs.scratch_path(spark, "built")
    whole = rows(build(c))
    half = build(c).filter("block_id % 2 = 0")
    fs.write_blocks(half, f"{path}/blocks/00000000000000000001-dead")           # no manifest follows

    def dies(todo):
        return build(todo).withColumn("toks", F.when(F.col("block_id") > 0, F.raise_error(F.lit("killed")).cast("array<int>"))
                                      .otherwise(F.col("toks")))

    with pytest.raises(Exception, match="killed"):
        fs.build_if_absent(c, dies, path).collect()
    assert fs.built_sources(spark, path).count() == 0 and rows(fs.read_built(spark, path)) == []
    assert fs.build_if_absent(c, build, path).count() == 3
    assert rows(fs.read_built(spark, path)) == whole


def test_only_absent_sources_are_built(spark):
    c, path = corpus(spark), fs.scratch_path(spark, "built")
    seen = []

    def watch(todo):
        seen.append({r.source for r in todo.select("source").distinct().collect()})
        return build(todo)

    assert {r.source for r in fs.build_if_absent(c.filter("source = 'en'"), watch, path).collect()} == {"en"}
    assert {r.source for r in fs.build_if_absent(c, watch, path).collect()} == {"de", None}
    assert fs.build_if_absent(c, watch, path).count() == 0
    assert seen == [{"en"}, {"de", None}] and rows(fs.read_built(spark, path)) == rows(build(c))


def test_first_of_two_builds_counts(spark):
    """Two callers that build one source at once: readers see one of the builds, whole."""
    c, path = corpus(spark), fs.scratch_path(spark, "built")
    fs.build_if_absent(c, lambda t: (fs.build_if_absent(c, build, path), build(t))[1], path)
    assert fs.manifest(spark, path).select("build").distinct().count() == 1
    assert rows(fs.read_built(spark, path)) == rows(build(c))


def test_build_reports_its_own_write(spark):
    watch = Observation()
    blocks = stored_blocks(corpus(spark), None, build=watch)
    want = blocks.agg(F.count("*"), F.sum(F.size("toks")), F.sum(F.when(F.col("split") == "val", F.size("toks")).otherwise(0)),
                      F.min(F.array_min("toks")), F.max(F.array_max("toks"))).first()
    assert tuple(watch.get[k] for k in ("blocks", "tokens", "val_tokens", "min_id", "max_id")) == tuple(want)


def test_guard_fails_the_write(spark):
    b = spark.createDataFrame([("a", "train", 0, [1, 2]), ("a", "train", 1, []), ("a", "train", 2, [260])],
                              "source string, split string, block_id long, toks array<int>")
    assert guarded(b, 261).count() == 3 and sorted(map(len, (r.toks for r in guarded(b, 261).collect()))) == [0, 1, 2]
    for bad, size in (([-1], 261), ([261], 261), ([65536], 10**6)):
        rows = spark.createDataFrame([("a", "train", 7, bad)], b.schema)
        with pytest.raises(Exception, match="in block 7"):
            guarded(rows, size).collect()
