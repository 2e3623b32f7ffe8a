"""Budget, head split and block layout (C2, C3, A5) against plain Python."""
import pytest
from pyspark.sql import functions as F

from wordloom.functions.ordering import prefix_sum
from wordloom.operators.tokens import budget_cut, head_split, to_blocks


def _docs(spark, lens, source="s"):
    rows = [(source, i, list(range(100 * i, 100 * i + n))) for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "source string, doc_id long, ids array<int>")
    return df.withColumn("n", F.size("ids").cast("bigint"))


def _python_build(lens, budget, frac):
    flat = []
    for i, n in enumerate(lens):
        flat += list(range(100 * i, 100 * i + n))
        if sum(lens[: i + 1]) >= budget:
            break
    toks = flat[:budget]
    n_val = int(len(toks) * frac)
    return toks[n_val:], toks[:n_val]


@pytest.mark.parametrize("budget", [0, 1, 7, 10, 12, 25, 1000])
def test_budget_and_split_match_python(spark, budget):
    lens = [5, 5, 2, 9, 4]     # boundaries at 5, 10, 12, 21, 25
    frac = 0.2
    segs = head_split(budget_cut(_docs(spark, lens), budget), frac)
    got = {}
    for split in ("train", "val"):
        rows = segs.filter(F.col("split") == split).orderBy("pos").collect()
        flat = [x for r in rows for x in r.ids]
        assert [r.pos for r in rows] == sorted(r.pos for r in rows)
        got[split] = flat
    train, val = _python_build(lens, budget, frac)
    assert got["train"] == train and got["val"] == val


@pytest.mark.parametrize("block", [3, 4, 100])
def test_blocks_equal_flat_slices(spark, block):
    lens = [5, 5, 2, 9, 4, 1, 7]
    segs = head_split(budget_cut(_docs(spark, lens), 1000), 0.1)
    blocks = to_blocks(segs, block=block).collect()
    for split in ("train", "val"):
        rows = segs.filter(F.col("split") == split).orderBy("pos").collect()
        flat = [x for r in rows for x in r.ids]
        mine = sorted((b.block_id, list(b.toks)) for b in blocks if b.split == split)
        assert [t for _, t in mine] == [flat[i:i + block] for i in range(0, len(flat), block)]


def test_prefix_sum_independent_of_bucket_and_partitions(spark):
    rows = [("a" if i % 3 else "b", i, (i * 7) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "source string, doc_id long, n long")
    want = {}
    for src in ("a", "b"):
        acc = 0
        for s, i, n in rows:
            if s == src:
                want[(s, i)] = acc
                acc += n
    for parts in (1, 5):
        got = prefix_sum(df.repartition(parts), ["source"], "doc_id", "n").collect()
        assert {(r.source, r.doc_id): r.off for r in got} == want


def _plain_offsets(rows):
    acc, out = {}, []
    for s, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        out.append((s, i, n, acc.get(s, 0)))
        acc[s] = acc.get(s, 0) + n
    return sorted(out, key=repr)


def test_prefix_sum_null_source_repeated_and_sparse_keys(spark):
    import random
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.choice([1, 2, 2, -(1 << 62), 1 << 62, rng.getrandbits(62), None]), rng.randrange(9))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "source string, doc_id long, n long").repartition(3)
    got = [(r.source, r.doc_id, r.n, r.off) for r in prefix_sum(df, ["source"], "doc_id", "n").collect()]
    assert sorted(got, key=repr) == _plain_offsets(rows)
    cut = budget_cut(df, {"a": 50}).collect()
    assert sum(r.m for r in cut if r.source == "a") == 50
    assert sum(r.m for r in cut if r.source is None) == sum(n for s, _, n in rows if s is None)


def test_cap_and_blend_with_repeated_keys_and_null_source(spark):
    from wordloom.operators.tokenizer import blend
    from wordloom.sources.corpus import cap_per_source
    rows = [("a", 0, 1, "x"), ("a", 0, 1, "y"), ("a", 0, 1, "z"), ("a", 0, 2, "w"), (None, 0, 1, "p"), (None, 0, 1, "p")]
    df = spark.createDataFrame(rows, "source string, ord int, doc_id long, text string")
    for cap, want in ((1, 2), (2, 4), (3, 5), (9, 6)):
        assert cap_per_source(df, cap).count() == want
    b = blend(df).collect()
    assert sorted((str(r.source), r.k) for r in b) == [("None", 0), ("None", 1), ("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    assert {r.doc_id for r in b if r.k == 3} == {2}


def test_documents_are_encoded_once(spark):
    """The plan behind the segments reads encoded rows; no encoder is left in it."""
    from wordloom.operators.bpe import BpeModel
    from wordloom.plans.corpus_build import token_segments
    df = spark.createDataFrame([("s", 0, i, "ab " * i) for i in range(9)] + [(None, 0, 1, "ab")],
                               "source string, ord int, doc_id long, text string")
    segs = token_segments(df, BpeModel([(102, 103)]), None)
    assert "MapInArrow" not in segs._jdf.queryExecution().executedPlan().toString()
    assert {r.source for r in segs.select("source").collect()} == {"s", None}


def test_merged_build_prunes_exactly(spark):
    """The lower-bound prune never drops a document the budget reaches."""
    from wordloom.operators.bpe import learn_merges
    from wordloom.operators.tokenizer import piece_counts
    from wordloom.plans.corpus_build import token_documents
    texts = ["the cat sat on the mat " * (i % 5 + 1) for i in range(40)]
    df = spark.createDataFrame([("s", 0, i, t) for i, t in enumerate(texts)],
                               "source string, ord int, doc_id long, text string")
    model = learn_merges(piece_counts(df), 275)
    for budget in (1, 37, 200, 10_000):
        got = token_documents(df, model, budget).orderBy("doc_id").collect()
        flat = [x for r in got for x in r.ids]
        full = token_documents(df, model, 10 ** 9).orderBy("doc_id").collect()
        want = [x for r in full for x in r.ids][:budget]
        assert flat == want, budget
