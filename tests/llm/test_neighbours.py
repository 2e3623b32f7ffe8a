import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "c", "c")
                                  for i, v in rows], SCHEMA).repartition(3)


def brute(rows, queries, k):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q in queries:
            s = [(-N.cosine(x, v), i) for i, v in ok if i != q]
            out[q] = [i for _, i in sorted(s)[:k]]
    return out


def test_recall(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((30, 16))
    x = centres[r.integers(0, 30, 6000)] + 0.6 * r.standard_normal((6000, 16))
    rows = list(enumerate(x.tolist()))
    got = N.search(frame(spark, rows), F.col("vec_id") % 50 == 0, sample=1000).collect()
    true = brute(rows, set(range(0, 6000, 50)), 5)
    hit = sum(r["vec_id"] in true[r["query_id"]] for r in got)
    assert len(got) == 5 * len(true) and hit >= 0.9 * 5 * len(true)
    xf = x.astype(np.float32).astype(np.float64)
    for r_ in got[:50]:
        assert abs(r_["score"] - N.cosine(xf[r_["query_id"]], xf[r_["vec_id"]])) < 1e-12
    by = {}
    for r_ in got:
        by.setdefault(r_["query_id"], []).append((r_["rank"], -r_["score"], r_["vec_id"]))
    assert all([a for a, _, _ in sorted(v)] == [1, 2, 3, 4, 5] and sorted(v) == sorted(v, key=lambda t: t[1:]) for v in by.values())


def test_hot_vector_and_small_parts(spark, monkeypatch):
    """A vector that a third of the rows share: ties go to the smaller ids."""
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 8))
    x[::3] = x[0]
    rows = list(enumerate(x.tolist()))
    monkeypatch.setattr(N, "PART", 100)
    monkeypatch.setattr(N, "QUERY_PART", 7)
    got = {}
    for r_ in N.search(frame(spark, rows), F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r_["query_id"], {})[r_["rank"]] = r_["vec_id"]
    true = brute(rows, set(range(0, 900, 50)), 5)
    assert got[0] == {1: 3, 2: 6, 3: 9, 4: 12, 5: 15} and got[150] == {1: 0, 2: 3, 3: 6, 4: 9, 5: 12}
    same = sum(list(dict(sorted(got[q].items())).values()) == true[q] for q in true)
    assert same >= 0.9 * len(true)


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (1, [0, 0]), (2, None), (3, [1, None]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (50, [2, 0]),
            (50, [2, 0]), (6, [1, 1]), (None, [1, 0]), (7, [1, 2, 3]), (100, [0, 0]), (8, [-1, 0]), (9, [])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in
           N.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 50, 1.0), (0, 2, 50, 1.0), (0, 3, 6, 0.707107), (0, 4, 8, -1.0),
                           (50, 1, 0, 1.0), (50, 2, 6, 0.707107), (50, 3, 8, -1.0)]
    assert N.search(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    alone = N.search(frame(spark, [(0, [1, 2])]), F.col("vec_id") % 50 == 0)
    assert alone.count() == 0


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    return {q: [x for _, x in sorted(v.items())] for q, v in out.items()}


def test_repeated_ids_do_not_crowd_out_others(spark):
    """Seven rows of the query's own id and vector leave the other ids of that vector in."""
    rows = [(0, [1, 2])] * 7 + [(i, [1, 2]) for i in range(1, 8)] + [(20, [1, 3]), (3, [1, 2])]
    got = answers(N.search(frame(spark, rows), F.col("vec_id") % 50 == 0, recall=1.0))
    assert got == {0: [1, 2, 3, 3, 4]}


def test_every_dimension_is_searched(spark):
    """A query whose vector is longer than most is answered among vectors as long."""
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(2 if i % 3 else 3).tolist()) for i in range(160)]
    got = answers(N.search(frame(spark, rows), F.col("vec_id") % 50 == 0, recall=1.0))
    for q, found in got.items():
        true = brute([x for x in rows if len(x[1]) == len(rows[q][1])], {q}, 5)
        assert found == true[q]
    assert set(got) == {0, 50, 100, 150}
