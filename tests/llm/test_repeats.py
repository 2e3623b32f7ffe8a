import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import anchors as A
from wordloom.llm import repeats as R


def brute(rows):
    """Rows in order of id to ``(n_bytes, n_removed, n_spans, kept_sha256)``."""
    seen, out = set(), []
    for i, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x) + 1, int)
        for k in range(len(x) - 99):
            s = x[k:k + 100]
            if s in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(s)
        m = np.cumsum(gone)[:len(x)] > 0
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((i, len(x), int(m.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    say = lambda n, abc="abcdefgh é": "".join(r.choice(abc) for _ in range(n))
    parts = [say(n) for n in (99, 100, 101, 130, 180, 400)]
    rows = []
    for i in range(80):
        t = "".join(r.choice([say(r.randrange(0, 120)), r.choice(parts), r.choice(parts)[r.randrange(40):]]) for _ in range(r.randrange(5)))
        rows.append((i, t))
    rows += [(100, "x" * 700), (101, "xy" * 400), (102, "abc" * 90 + "d" + "abc" * 90), (103, rows[5][1]), (104, None), (105, ""),
             (106, "a\0" * 150), (107, "\0" * 130), (108, say(30_000) + parts[5] + "é" * 200)]
    return rows


@pytest.mark.parametrize("hot", [R.HOT, 2])
def test_against_brute_force(spark, hot):
    rows = texts(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.repeat_report(df, hot=hot).collect())
    assert got == brute(rows)


def test_anchors_of_pieces_are_those_of_the_whole():
    from wordloom.llm.shared import _powers
    up, down = _powers()
    data = np.random.default_rng(2).integers(0, 3, 5000).astype(np.uint8)
    data[1000:2000] = 7
    whole = A.text_anchors(data, up, down)
    parts = A.text_anchors(data, up, down, piece=333)
    assert all((a == b).all() for a, b in zip(whole, parts))
    h = A.mix64(A._gram_hashes(data))
    w = A.LENGTH - A.GRAM + 1
    assert whole[0].tolist() == sorted({i + int(np.argmin(h[i:i + w])) for i in range(len(h) - w + 1)})


def test_interval_tree_holds_all_occurrences():
    """Every group has all members that share its string, and differs on the left."""
    right = [b"S" * 40 + x for x in (b"a" * 60, b"a" * 60, b"b" * 60, b"b" * 59 + b"c", b"a" * 30 + b"z" * 30)]
    left = [b"L" * 68, b"L" * 60 + b"Q" * 8, b"L" * 68, b"L" * 68, b"L" * 68]
    groups = {(b, a): sorted(m.tolist()) for b, a, m in R.maximal_repeats(left, right)}
    assert groups == {(60, 100): [0, 1], (68, 99): [2, 3], (68, 70): [0, 4], (60, 70): [0, 1, 4], (68, 40): [0, 2, 3, 4],
                      (60, 40): [0, 1, 2, 3, 4]}


def test_rows_that_share_an_id(spark):
    """Rows are documents of their own: copies go but for one, and texts whose 32-bit hashes
    are equal do not mix."""
    made = spark.range(300_000).select(F.concat(*(F.sha2(F.concat(F.lit(x), "id"), 256) for x in "ab")).alias("text"))
    u, v = made.groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("t")).filter("size(t) > 1").first()["t"][:2]
    w = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(3))
    rows = [(None, u)] * 3 + [(None, v)] * 2 + [(7, w)] * 2 + [(7, u[:120] + w[:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = R.repeat_report(df).collect()
    assert len(seen) == len(rows)
    assert sorted(r["n_removed"] for r in seen if r["n_bytes"] == len(w)) == [0, len(w)]
    nulls = [(r["n_removed"], r["kept_sha256"]) for r in seen if r["doc_id"] is None]
    rest, none = (hashlib.sha256(x.encode()).hexdigest() for x in (u[120:], ""))
    assert sorted(nulls) == sorted([(120, rest), (128, none), (128, none), (0, hashlib.sha256(v.encode()).hexdigest()), (128, none)])


def test_odd_rows(spark, odd, odd_rows, empty):
    got = R.repeat_report(odd).collect()
    assert len(got) == len(odd_rows) and R.repeat_report(empty).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_removed"] == 0 and by[3]["n_removed"] == 0 and by[5]["n_bytes"] == 0
    assert by[2]["n_removed"] == by[2]["n_bytes"]                 # a copy, itself twice
    assert by[13]["n_removed"] > 0.9 * by[13]["n_bytes"] and by[12]["n_removed"] == 1999
    last = [r for r in got if r["doc_id"] is None]                 # rows without an id come last
    assert sorted(r["n_removed"] for r in last) == [0, by[1]["n_bytes"]]
