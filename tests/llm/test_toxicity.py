import random
import zlib

import numpy as np

from wordloom.llm import toxicity as T
from wordloom.llm.shared import hashed_words, text_bytes, word_list
import pyarrow as pa

BAD = ("idiot", "scum", "moronic")


def corpus(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 150))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(BAD)
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_words_equal_plain_split():
    texts = ["", None, "Aa-b É.x", "日本 語", "x" * 3_000_000 + " y", "a b " * 400_000, " ", "0a9Z_z~"]
    data, off = text_bytes(pa.array(texts))
    rows, s, e, h = hashed_words(data, off)
    for i, t in enumerate(texts):
        got = [data[off[i] + a:off[i] + b].tobytes() for a, b in zip(s[rows == i], e[rows == i])]
        want = word_list(t)
        assert [g.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for g in got] == want
    assert len(set(h[rows == 5].tolist())) == 2


def test_windows_cover_every_word():
    rows = np.repeat(np.arange(5), [0, 1, T.WINDOW, T.WINDOW + 1, 500])
    w_row, first, length = T.windows(rows, 5)
    hit = np.zeros(len(rows), int)
    for r, f, n in zip(w_row, first, length):
        assert (rows[f:f + n] == r).all() and n <= T.WINDOW
        hit[f:f + n] += 1
    assert (hit > 0).all() and 0 not in w_row


def test_a_passage_lies_whole_in_a_window_at_every_offset():
    for n in (10, 24, 25, 36, 37, 61, 100):
        _, first, length = T.windows(np.zeros(n, np.int64), 1)
        for at in range(n - 9):
            assert any(f <= at and at + 10 <= f + k for f, k in zip(first, length)), (n, at)


def test_gradient_is_the_slope():
    r = np.random.default_rng(1)
    vocab = T.Vocabulary(T.mix64(np.arange(1, 40, dtype=np.uint64)))
    net = T.GatedNet(vocab, r.standard_normal(len(vocab.keys)).astype(np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = len(vocab.keys)
    ids = [r.integers(1, n, 60) for _ in range(1 + len(T.GRAMS))]
    at, mask = T.grid(np.array([0, 20]), np.array([T.WINDOW, 7]))
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        z = net.logits(net.inputs(ids), at, mask).astype(np.float64)
        p = T.sigmoid(z)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = net.gradient(ids, at, mask, y, weight)
    for k in net.p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, eps = net.p[k][i], 1e-2
        net.p[k][i] = old + eps
        up = loss()
        net.p[k][i] = old - eps
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-3 + 0.05 * abs(g[k][i]), k


def test_held_out_documents(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts, y = T.training_rows(docs, labels)
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)
    few, _ = T.training_rows(docs, labels, max_positive=20, max_negative=30)
    assert len(few) == 50
    net = T.fit(texts, y)
    got = {r["doc_id"]: r["score"] for r in T.score(docs, net, ["doc_id"]).collect()}
    held = [(got[i] >= T.THRESHOLD, bool(t)) for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    again = T.score(docs.repartition(2), T.fit(texts, y), ["doc_id"]).collect()
    assert all(abs(got[r["doc_id"]] - r["score"]) < 1e-5 for r in again)


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (4, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    net = T.train(odd, labels)
    rows = T.score(odd, net, odd.columns, out="score").collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if net and not word_list(r["text"]))
    one = spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int")
    assert T.train(odd, one) is None
    assert {r["score"] for r in T.score(odd, None, ["doc_id"]).collect()} == {0.5}
    assert T.train(empty, one) is None and T.score(empty, net, ["doc_id"]).count() == 0
