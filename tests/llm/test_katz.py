import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import katz as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOW)), "\n"]


class Plain:
    """Katz by recursion over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = ["\t"] * (order - 1) + tokens_of(t)
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(w[i - n + 1:i + 1])] += 1
        self.d = [None] * (order + 1)
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for n in range(1, order + 1):
            cc = Counter(self.counts[n].values())
            self.d[n] = M.discounts(np.array([0, *(cc[r] for r in range(1, M.K + 2))]))
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]][g[-1]] = c
        self.n = sum(self.counts[1].values())
        self.v = len(self.counts[1])

    def ratio(self, n, c):
        return self.d[n][c] if c <= M.K else 1.0

    def p(self, history, w):
        seen = self.after[len(history) + 1].get(history, {})
        n, total = len(history) + 1, sum(seen.values())
        if not total:
            return self.p(history[1:], w) if history else 1.0
        held = sum(c * (1 - self.ratio(n, c)) for c in seen.values()) / total
        flat = all(c > M.K for c in seen.values())
        if w in seen:
            return seen[w] / (total + 1) if flat else self.ratio(n, seen[w]) * seen[w] / total
        left = 1 / (total + 1) if flat else held
        return left / (1 - sum(self.p(history[1:], x) for x in seen)) * self.p(history[1:], w) if history else left

    def row(self, text):
        w = ["\t"] * (self.order - 1) + tokens_of(text)
        c = [self.counts[1][x,] for x in w[self.order - 1:]]
        score = sum(math.log10(self.p(tuple(w[i - self.order + 1:i]), w[i])) for i in range(self.order - 1, len(w)))
        return len(c), sum(x > 0 for x in c), sum(math.log10((x + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in c), score


def corpus(seed, n):
    r = random.Random(seed)
    words = ["The", "the", "a", "Ü", "x\x00", "...", "end"] + [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(r.choice(words[:r.choice([4, 9, 57])]) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, " \n"), (None, "no id the"), (5, docs[5][1]), (903, "the " * 300)]


def check(got, docs, held, order):
    plain = Plain([t for i, t in docs if not (i is not None and held(i))], order)
    rows = sorted(got, key=lambda r: (r["doc"] is None, r["doc"] or 0, r["n"], r["score"]))
    want = sorted([(i, *plain.row(t)) for i, t in docs], key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
    assert len(rows) == len(want)
    for r, (i, n, known, base, score) in zip(rows, want):
        assert (r["doc"], r["n"], r["n_known"], r["held"]) == (i, n, known, i is not None and held(i))
        assert r["base"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9), r


@pytest.mark.parametrize("order,chunk,bucket,hot", [(2, 64, 200, 40), (3, 50, 300, 25), (1, 1000, 500, 10), (3, 1 << 20, 1 << 19, 1 << 22)])
def test_brute_force(spark, order, chunk, bucket, hot):
    """Tiny chunks cut documents, many buckets, and histories split over them."""
    docs = corpus(order, 60)
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, key string, n int").repartition(3)
    model = M.Katz(d, F.col("doc_id") % 4 == 0, order, chunk=chunk, bucket=bucket, hot=hot)
    check(model.scores().collect(), docs, lambda i: i % 4 == 0, order)
    if hot == 40:
        assert len(model.hots[2][0]) > 0


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t in corpus(9, 40)], 3)
    words = [w for w, in plain.counts[1]] + ["never-seen"]
    for history in [(), ("the",), ("never-seen",), ("\t", "\t"), ("w1", "w2"), ("the", "the"), ("a", "w3")]:
        assert sum(plain.p(history, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_tables_hold_the_counts(spark):
    docs = corpus(4, 30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = M.Katz(d, F.lit(False), 2, chunk=100, bucket=150, hot=30)
    plain = Plain([t for _, t in docs], 2)
    words, grams = model.words().collect(), model.grams(2).collect()
    assert sorted(r["count"] for r in words) == sorted(plain.counts[1].values())
    assert sorted(r["count"] for r in grams) == sorted(plain.counts[2].values())
    assert len({r["id"] for r in words}) == len(words) and len({(r["history"], r["id"]) for r in grams}) == len(grams)
    assert model.uni.unknown + sum(r["p"] for r in words) == pytest.approx(1, abs=1e-9)


def test_discounts():
    n = np.array([0, 1000, 400, 220, 140, 100, 75])
    d = M.discounts(n)
    a = 6 * 75 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - a) / (1 - a)) and ((d[1:] > 0) & (d[1:] < 1)).all()
    assert M.discounts(np.zeros(7))[1:].tolist() == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]


def test_pack():
    r = np.random.default_rng(1)
    for a in (r.integers(0, 1 << 62, 100), np.zeros(0, np.int64), r.random(7), np.arange(5, dtype=np.uint8)):
        assert (M.unpack(M.pack(a), a.dtype) == a).all()
    a = np.sort(r.integers(0, 1 << 63, 50, dtype=np.uint64))
    assert (M.unpack(M.pack(a, delta=True), np.uint64, delta=True) == a).all()


def test_odd_and_empty_rows(spark, odd, odd_rows, empty):
    import zlib
    rows = M.score(odd).collect()
    got = [{"doc": r["doc_id"], "held": r["held_out"], "n": r["n_tokens"], "n_known": r["n_known"], "base": r["base_score"],
            "score": r["score"]} for r in rows]
    docs = [(x[0], x[1]) for x in odd_rows if x[1] is None or len(x[1]) < 10_000]
    assert M.score(empty).count() == 0 and len(rows) == len(odd_rows)
    small = odd.filter("text is null or length(text) < 10000")
    model = M.Katz(small, M.held_out(), 2)
    check(model.scores().collect(), docs, lambda i: zlib.crc32(str(i).encode()) % 10 == 0, 2)
    assert {g["held"] for g in got} <= {True, False} and all(g["score"] <= 0 for g in got)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in M.Katz(d, F.lit(True), 2).scores().collect())
    assert rows == [(1, True, 3, 0, 0.0, 0.0), (2, True, 1, 0, 0.0, 0.0)]
