import math
import random
import re

import numpy as np
import pytest

from wordloom.llm import ranked_search as R

TERM = re.compile(R.TERM)


def terms_of(text):
    return TERM.findall((text or "").translate(str.maketrans(R.UPPER, R.LOWER)))


def plain(docs, items, k):
    lists = [(i, terms_of(t)) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n_docs, n_words = len(lists), sum(len(w) for _, w in lists)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in lists:
            m = 50 + (50 * len(w) * n_docs) // n_words
            s = 0
            for t in terms & set(w):
                df = sum(t in x for _, x in lists)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,block_terms", [(1, 10**6), (2, 7)])
def test_brute_force(spark, monkeypatch, seed, block_terms):
    monkeypatch.setattr(R, "SLAB", 2)
    r = random.Random(seed)
    words = ["The", "the", "Ünit", "a1", "x", "yy", "zzz", "q-r", "[b]", "\x00k"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(words[:r.randrange(2, 50)]) for _ in range(n))
    docs = [(r.choice([None, *range(80)]), text(r.randrange(0, 40))) for _ in range(90)] + [(7, None), (8, ""), (9, "--")]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [docs[5]] * 3                # ties and repeated rows
    items = [(r.choice([None, *range(9)]), text(r.randrange(0, 25))) for _ in range(14)] + [(50, None), (51, ""), (52, "none-such")]
    d = spark.createDataFrame([(*x, "clash", 0) for x in docs], "doc_id long, text string, term string, n int").repartition(4)
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    assert got(R.search(d, i, 6, block_terms=block_terms)) == plain(docs, items, 6)


def test_long_items_and_groups():
    present = np.random.default_rng(0).random((130, 40)) < 0.5
    present[:, 7] = present[:, 3]
    masks, group = R.mask_groups(present)
    assert (masks[group] == present.T).all() and group[7] == group[3] and len(masks) == 39


def test_hopeless_documents_are_not_scored(monkeypatch):
    """A chunk whose masks cannot reach the k-th best is left unscored, whole or in part."""
    monkeypatch.setattr(R, "SLAB", 4)
    present = np.array([[1] * 50 + [0] * 50, [1] * 10 + [0] * 90], bool)
    share = np.where(present, 100, 0).astype(np.int32)
    best = R.Best(3)
    args = (present, share, np.array([5, 5]), np.arange(100), np.zeros(100, bool), np.array([0, 1]), np.array([100, 100]), best)
    first = R.search_chunk(*args)
    assert first == 10 and best.doc.tolist() == [0, 1, 2] and best.score.tolist() == [1000] * 3
    best.score[:] = 1001
    assert R.search_chunk(*args) == 0


def test_odd_and_empty_rows(spark, odd, odd_rows, empty):
    items = [(1, odd_rows[0][1][:80]), (2, "one word no id here"), (None, "ab1 ab2")]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(R.search(odd, i, 5)) == plain([(x[0], x[1]) for x in odd_rows], items, 5)
    assert R.search(empty, i).count() == 0 and R.search(odd, i.limit(0)).count() == 0
