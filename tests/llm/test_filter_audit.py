import math
import random
from itertools import permutations

import pytest

from wordloom.llm import filter_audit as A


def test_path_counts_are_factorials():
    for k in range(6):
        reach, leave = A.path_counts(k)
        for s in range(1 << k):
            n = s.bit_count()
            assert reach[s] == math.factorial(n) and leave[s] == math.factorial(k - n)


def plain(docs, labels):
    """Every order walked document by document."""
    good = {i for i, q, t in labels if q == 1}
    toxic = {i for i, q, t in labels if t == 1}
    failed = []
    for i, source, text in docs:
        t = text or ""
        w = [x for x in __import__("re").split("[\x20\t-\r]+", t) if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
             "D": any(c in "#$%&*|" for c in t),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs)}
        failed.append((source or "", i, {k for k, v in f.items() if v}))
    rows, shapley = {}, {}
    for part in {p for p, _, _ in failed}:
        for order in permutations("ABCDE"):
            alive = [(i, f) for p, i, f in failed if p == part]
            for step, name in enumerate(order, 1):
                out = [(i, f) for i, f in alive if name in f]
                alive = [(i, f) for i, f in alive if name not in f]
                of = [f for p, _, f in failed if p == part and name in f]
                rows[part, "".join(order), step] = (len(alive), len(out), len(of) - len(out), sum(len(f) == 1 for f in of),
                                                    sum(i in good and i is not None for i, _ in out),
                                                    sum(i in toxic and i is not None for i, _ in out))
                shapley[part, name] = shapley.get((part, name), 0) + len(out)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def table(df):
    out = {}
    for r in df.collect():
        key = r["part"], r["filter_order"], r["step"]
        assert key not in out
        out[key] = tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return out


def test_brute_force(spark):
    r = random.Random(5)
    words = ["ab", "CD", "efg", "Ü", "x#", "yy", "zzz", "kl", "\x00q"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words[:r.randrange(3, 69)]) for _ in range(r.randrange(0, 90))) for _ in range(40)] + [None, "", "ABC"]
    docs = [(r.choice([None, *range(60)]), r.choice(["a", "b", None, ""]), r.choice(texts)) for _ in range(150)]
    labels = [(r.choice([None, *range(60)]), r.randrange(2), r.choice([0, 1, None])) for _ in range(70)]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, source string, text string, part string, mask int").repartition(3)
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert table(A.audit(d, t)) == plain(docs, labels)


def test_odd_and_empty_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert table(A.audit(odd, labels)) == plain([(x[0], x[3], x[1]) for x in odd_rows], [(2, 1, 0), (2, 0, 1)])
    assert A.audit(empty, labels).count() == 0
    assert A.audit(odd, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        A.lattice(spark.createDataFrame([("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long"), 8)
