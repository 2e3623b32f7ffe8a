"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs.

Each word enters as the sum of its word embedding and the embeddings of its leading and
trailing byte n-grams. Overlapping windows of ``WINDOW`` words (step ``STEP``) cover the whole
text; each is read by a forward and a backward GRU, pooled by attention, and scored. A
document's score is its highest window's, scaled so that ``THRESHOLD`` splits the classes of
validation documents best. Training is plain NumPy (Adam, back-propagation through time) on a
bounded sample of labelled documents; documents carry one label, so the windows that stand
for a toxic document are chosen by word evidence first and by the model afterwards.

Training runs in one task on the bounded sample. Scoring is one pass of ``mapInArrow``; the model (some MB, bounded by ``MAX_VOCAB``) is
broadcast. ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` bound the training documents; the sample is
the lowest hashes of doc_id, so reruns agree.

Defined cases: null and empty texts, and texts without words, get 0; rows without a label are scored alike; repeated labels of a doc_id count as toxic if
one is; without both classes in the sample every row gets 0.5; null ids are scored; an empty
table gives an empty result.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_LUT, hashed_words, mix64, row_slices, small_batches, text_bytes, with_fields

WINDOW, STEP = 24, 12         # a passage of up to 13 words lies whole in a window
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
MAX_VOCAB = 30_000
MIN_DOCS = 3
MAX_POSITIVE, MAX_NEGATIVE = 1_500, 3_000
THRESHOLD = 0.7
ROUNDS, EPOCHS, BATCH, RATE = 2, 3, 256, 0.015
BLOCK = 1_024                       # windows scored at once
GRAMS = (("p", 3), ("p", 4), ("p", 5), ("s", 3), ("s", 4))


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each word, and its feature keys: the word, then each n-gram (0: too short)."""
    rows, s, e, h = hashed_words(data, offsets)
    keys = [h | np.uint64(1)]
    at = offsets[rows] + s
    n = e - s
    end = at + n
    for k, (side, size) in enumerate(GRAMS):
        g = np.zeros(len(h), np.uint64)
        ok = n >= size
        p = at[ok] if side == "p" else end[ok] - size
        x = np.zeros(len(p), np.uint64)
        for i in range(size):
            x = (x << np.uint64(8)) | WORD_LUT[data[p + i]].astype(np.uint64)
        g[ok] = mix64(x + np.uint64((k + 1) << 56)) | np.uint64(1)
        keys.append(g)
    return rows, keys


class Vocabulary:
    """Feature keys to ids by one probe: id 0 is unknown."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)     # keys come by frequency: the first stays
        self.keys = np.concatenate([np.zeros(1, np.uint64), keys[np.sort(first)]])
        self.table = None

    def __getstate__(self):
        return {"keys": self.keys, "table": None}

    def ids(self, keys: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << self.BITS, np.int32)
            self.table[(self.keys[1:] >> np.uint64(64 - self.BITS)).astype(np.int64)] = np.arange(1, len(self.keys))
        i = self.table[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)]
        return np.where(self.keys[i] == keys, i, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class GatedNet:
    """Parameters and passes of the network; windows are ``(first word, length)``."""

    def __init__(self, vocab: Vocabulary, weight_of: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        n, d, k = len(vocab.keys), WORD_DIM + CHAR_DIM, HIDDEN
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.vocab = vocab
        p = {"word": f(n, WORD_DIM, scale=0.02), "char": f(n, CHAR_DIM, scale=0.02)}
        p["word"][:, 0] = p["char"][:, 0] = weight_of
        p["word"][0] = p["char"][0] = 0
        for side in "fb":
            p["W" + side] = f(d, 3 * k, scale=d ** -0.5)
            p["U" + side] = f(k, 3 * k, scale=k ** -0.5)
            p["c" + side] = np.zeros(3 * k, np.float32)
        p["A"], p["v"] = f(2 * k, k, scale=(2 * k) ** -0.5), f(k, scale=0.3)
        p["w"], p["b"] = f(2 * k, scale=0.3), np.zeros(1, np.float32)
        self.p = p
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, ids: list[np.ndarray]) -> np.ndarray:
        c = self.p["char"][ids[1]]
        for i in ids[2:]:
            c += self.p["char"][i]
        return np.concatenate([self.p["word"][ids[0]], c], axis=1)

    def _run(self, side: str, proj: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None):
        """States ``(time, window, hidden)`` of one direction; ``proj`` holds each word's gates."""
        k, u = HIDDEN, self.p["U" + side]
        steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((at.shape[0], k), np.float32)
        out = np.empty((WINDOW, at.shape[0], k), np.float32)
        for t in steps:
            x = proj[at[:, t]]
            g = h @ u
            zr = x[:, :2 * k] + g[:, :2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :k], zr[:, k:]
            n = r * g[:, 2 * k:]
            n += x[:, 2 * k:]
            n *= -2.0
            np.exp(n, out=n)
            n += 1.0
            np.reciprocal(n, out=n)
            n *= 2.0
            n -= 1.0                                     # tanh by the faster exponential
            new = n + z * (h - n)
            new *= mask[:, t:t + 1]
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * k:]))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window logits; ``x`` are word inputs, ``at`` (window, time) indexes them."""
        p = self.p
        hs = []
        for side in "fb":
            proj = x @ p["W" + side] + p["c" + side]
            np.clip(proj, -30, 30, out=proj)
            trace = [] if keep is not None else None
            hs.append(self._run(side, proj, at, mask, trace))
            if keep is not None:
                keep[side] = trace
        h = np.concatenate(hs, axis=2)
        u = np.tanh(h @ p["A"])
        s = (u @ p["v"]) + np.where(mask.T > 0, 0, np.float32(-1e9))
        s -= s.max(axis=0)
        a = np.exp(s) * mask.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        c = np.einsum("tn,tnk->nk", a, h)
        if keep is not None:
            keep |= {"h": h, "u": u, "a": a, "c": c}
        return c @ p["w"] + p["b"][0]

    def gradient(self, ids: list[np.ndarray], at: np.ndarray, mask: np.ndarray, y: np.ndarray,
                 weight: np.ndarray) -> dict:
        p, k = self.p, HIDDEN
        keep: dict = {}
        x = self.inputs(ids)
        z0 = self.logits(x, at, mask, keep)
        d = ((sigmoid(z0) - y) * weight / weight.sum()).astype(np.float32)
        h, u, a, c = keep["h"], keep["u"], keep["a"], keep["c"]
        g = {"w": c.T @ d, "b": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["w"]
        da = np.einsum("tnk,nk->tn", h, dc)
        ds = a * (da - (a * da).sum(axis=0))
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["v"] = np.einsum("tn,tnk->k", ds, u)
        g["A"] = np.einsum("tni,tnj->ij", h, du)
        dh = a[:, :, None] * dc + du @ p["A"].T
        dx = np.zeros_like(x)
        for i, side in enumerate("fb"):
            U, own = p["U" + side], dh[:, :, i * k:(i + 1) * k]
            gu, gw = np.zeros_like(U), np.zeros_like(p["W" + side])
            gc = np.zeros(3 * k, np.float32)
            carry = np.zeros_like(own[0])
            for t, h0, z, r, n, gn in reversed(keep[side]):
                dt = (own[t] + carry) * mask[:, t:t + 1]
                dn = dt * (1 - z) * (1 - n * n)
                dz = dt * (h0 - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                gu += h0.T @ dg
                carry = dt * z + dg @ U.T
                dp = np.concatenate([dz, dr, dn], axis=1)
                gc += dp.sum(axis=0)
                xt = x[at[:, t]]
                gw += xt.T @ dp
                np.add.at(dx, at[:, t], dp @ p["W" + side].T)
            g["U" + side], g["W" + side], g["c" + side] = gu, gw, gc
        gword, gchar = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(gword, ids[0], dx[:, :WORD_DIM])
        for i in ids[1:]:
            np.add.at(gchar, i, dx[:, WORD_DIM:])
        gword[0] = gchar[0] = 0
        return g | {"word": gword, "char": gchar}

    def document_logits(self, rows: np.ndarray, ids: list[np.ndarray], n_rows: int):
        """Highest window logit of each row, and the windows ``(row, first, length, logit)``."""
        w_row, first, length = windows(rows, n_rows)
        z = np.empty(len(first), np.float32)
        for i in range(0, len(first), BLOCK):
            f, n = first[i:i + BLOCK], length[i:i + BLOCK]
            lo, hi = (int(f[0]), int(f[-1] + n[-1])) if len(f) else (0, 0)
            x = self.inputs([k[lo:hi] for k in ids])
            at, mask = grid(f - lo, n)
            z[i:i + BLOCK] = self.logits(x, at, mask)
        best = np.full(n_rows, self.p["b"][0], np.float32)
        seen = np.zeros(n_rows, bool)
        seen[w_row] = True
        best[seen] = -np.inf
        np.maximum.at(best, w_row, z)
        return best, (w_row, first, length, z)

    def score(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * (logits.astype(np.float64) - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD)))


def windows(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of all rows; the last one of a row ends with it."""
    n = np.bincount(rows, minlength=n_rows)
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    per = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)))
    w_row = np.repeat(np.arange(n_rows), per)
    k = np.arange(len(w_row)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * STEP, np.maximum(n[w_row] - WINDOW, 0))
    return w_row, base[w_row] + start, np.minimum(n[w_row], WINDOW)


def grid(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)
    at = first[:, None] + np.minimum(t, np.maximum(length - 1, 0)[:, None])
    return at, (t < length[:, None]).astype(np.float32)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t, self.rate = 0, rate

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k in p:
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g[k] - m)
            v += 0.001 * (g[k] * g[k] - v)
            p[k] -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> GatedNet | None:
    """Train on documents; None without both classes."""
    y = np.asarray(toxic).astype(bool)
    if not y.any() or y.all():
        return None
    data, off = text_bytes(pa.array(texts, pa.large_string()))
    rows, keys = word_features(data, off)
    n_docs = len(texts)
    # document frequencies of features by class
    parts = []
    for k in keys:
        order = np.lexsort((rows, k))
        kk, rr = k[order], rows[order]
        new = np.ones(len(kk), bool)
        new[1:] = (kk[1:] != kk[:-1]) | (rr[1:] != rr[:-1])
        kk, rr = kk[new], rr[new]
        u, inv = np.unique(kk, return_inverse=True)
        pos = np.bincount(inv, weights=y[rr], minlength=len(u))
        parts.append((u, pos, np.bincount(inv, minlength=len(u))))
    key = np.concatenate([p[0] for p in parts])
    pos = np.concatenate([p[1] for p in parts])
    df = np.concatenate([p[2] for p in parts])
    ok = (df >= min(MIN_DOCS, max(1, y.sum() // 4))) & (key != 0)
    key, pos, df = key[ok], pos[ok], df[ok]
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((df - pos + 0.5) / ((~y).sum() + 1))
    odds *= df / (df + 3.0)
    order = np.lexsort((key, -(np.abs(odds) * np.minimum(df, 50))))[:MAX_VOCAB]
    vocab = Vocabulary(key[order])
    by_key = dict(zip(key[order].tolist(), (odds[order] / 1.5).tolist()))
    weight_of = np.array([by_key.get(int(k), 0.0) for k in vocab.keys], np.float32)
    ids = [vocab.ids(k) for k in keys]
    net = GatedNet(vocab, weight_of, seed)
    rng = np.random.default_rng(seed)
    w_row, first, length = windows(rows, n_docs)
    evidence = weight_of[ids[0]] + sum(weight_of[i] for i in ids[1:]) / len(GRAMS)
    peak = np.concatenate([evidence, [-np.inf]])
    at, _ = grid(first, length)
    z = peak[at].max(axis=1) if len(first) else np.zeros(0)
    adam = Adam(net.p, RATE)
    held = rng.random(n_docs) < 0.2
    if (y & held).sum() < 20:
        held[:] = False
    for rnd in range(ROUNDS):
        if rnd:
            _, (_, _, _, z) = net.document_logits(rows, ids, n_docs)
        order = np.lexsort((-z, w_row))
        rank = np.arange(len(order)) - np.searchsorted(w_row[order], w_row[order])
        top = order[rank == 0]
        extra = order[rank == 1]
        extra = extra[~y[w_row[extra]]]                   # hard negatives
        other = rng.permutation(np.flatnonzero(~y[w_row]))[:len(top)]
        pick = np.concatenate([top, extra, other])
        pick = pick[~held[w_row[pick]]]
        label = y[w_row[pick]].astype(np.float32)
        balance = np.where(label > 0, max(1.0, (label == 0).sum() / max(1, label.sum()) / 2), 1.0)
        steps = max(1, -(-len(pick) // BATCH))
        for epoch in range(EPOCHS if steps >= 30 else EPOCHS * min(8, 30 // steps)):
            adam.rate = RATE * (0.5 ** (rnd * 1.0 + epoch / max(EPOCHS, 1)))
            for chunk in np.array_split(rng.permutation(len(pick)), steps):
                w = pick[chunk]
                at, mask = grid(first[w], length[w])
                used, inv = np.unique(at, return_inverse=True)
                g = net.gradient([i[used] for i in ids], inv.reshape(at.shape), mask, label[chunk],
                                 balance[chunk])
                adam.step(net.p, g)
    best, _ = net.document_logits(rows, ids, n_docs)
    check = held if held.any() else np.ones(n_docs, bool)
    net.shift, net.scale = _split(best[check], y[check])
    return net


def _split(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logit that splits the classes best (a third into the gap), and a scale by which
    the class medians lie some units apart."""
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    wrong = np.cumsum(ys) + (~ys).sum() - np.cumsum(~ys)          # cut after each row
    wrong = np.concatenate([[(~ys).sum()], wrong])
    ties = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate([[zs[0] - 1], zs, [zs[-1] + 1]])
    i = ties[np.argmax(edge[ties + 1] - edge[ties])]
    shift = float((2 * edge[i] + edge[i + 1]) / 3)
    apart = float(np.median(z[y]) - np.median(z[~y]))
    return shift, float(np.clip(6.0 / max(apart, 1e-3), 0.05, 5.0))


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """A bounded sample of labelled documents of the training folds: ``(__id, text, toxic)``."""
    known = (labels.select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("__id is not null and toxic is not null")
             .groupBy("__id").agg(F.max("toxic").alias("toxic"))
             .filter(F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(3)) != 1)
             .withColumn("__h", F.xxhash64("__id")))
    picked = [known.filter(F.col("toxic") == t).orderBy("__h", "__id").limit(n)
              for t, n in ((1, max_positive), (0, max_negative))]
    keys = picked[0].unionByName(picked[1]).select("__id", "toxic")
    return (docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(keys), "__id")
            .groupBy("__id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))


def training_rows(docs: DataFrame, labels: DataFrame, **bounds) -> tuple[list[str], np.ndarray]:
    got = sample_rows(docs, labels, **bounds).orderBy("__id").collect()
    return [r["text"] or "" for r in got], np.array([r["toxic"] for r in got], bool)


def score(docs: DataFrame, net: GatedNet | None, columns: list[str], text_col: str = "text",
          out: str = "score") -> DataFrame:
    """``columns`` with the score as ``out``."""
    names = list(dict.fromkeys([*columns, text_col]))
    schema = with_fields(docs.select(*columns).schema, f"`{out}` double")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in small_batches(batches, text_col):
            data, off = text_bytes(b.column(text_col))
            n = len(off) - 1
            if model is None:
                s = np.full(n, 0.5)
            else:
                s = np.empty(n)
                for i, j in row_slices(off, 1 << 21):
                    rows, keys = word_features(data, off[i:j + 1])
                    best, _ = model.document_logits(rows, [model.vocab.ids(k) for k in keys], j - i)
                    s[i:j] = np.where(np.bincount(rows, minlength=j - i) > 0, model.score(best), 0.0)
            keep = [c for c in columns if c != out]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], names=[*keep, out])

    return docs.select(*names).mapInArrow(run, schema)




def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, toxic = [], []
    for b in batches:
        texts += [t or "" for t in b.column("text").to_pylist()]
        toxic += b.column("toxic").to_pylist()
    net = fit(texts, np.array(toxic, bool)) if texts else None
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])


def train(docs: DataFrame, labels: DataFrame, **bounds) -> GatedNet | None:
    """Fit in one task: the sample is bounded by its parameters, the driver gets the model only."""
    one = sample_rows(docs, labels, **bounds).repartition(1).sortWithinPartitions("__id")
    got = one.select("text", "toxic").mapInArrow(_fit_task, "net binary").collect()
    return pickle.loads(bytes(got[0]["net"])) if got else None
