"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

The probability of a token after a history is its discounted relative frequency where the
training documents hold that n-gram, else the history's backoff weight times the probability
after the history less its first token; below the unigrams stands one class for all unknown
words. With ``h`` a history, ``C`` its count, ``m_r`` the number of its successors seen ``r``
times and ``q`` the lower-order model, the weight is

    alpha(h) = (sum over r of m_r r (1 - d_r) / C) / (1 - sum of q over the successors of h)

so the probabilities after any history sum to one. ``d_1 .. d_5`` are Katz's ratios from the
counts of counts of the order; where those do not give ratios between 0 and 1 (small or odd
corpora) half an occurrence is held back instead (``1 - 1 / 2r``). A history all of whose
successors are seen more than five times holds back ``1 / (C + 1)``, and so do the unigrams.

How it runs. A first pass writes the tokens in chunks of at most ``CHUNK`` tokens: a sorted
dictionary of word hashes and a row of it per token, bucketed by chunk. Then, order by order,
every chunk sends the distinct n-grams it holds, with their training counts and the
lower-order probability of their last word, to buckets of histories; a bucket sums the counts,
stores its part of the model's table and answers each chunk in the chunk's own order, so
answers carry counts and no keys. The answer to the last order scores the tokens, from the
unigram up. Chunks meet their answers without moving: the chunk table is bucketed, only the
answers are shuffled. Words are known by a 64-bit hash and get dense ids; n-grams of ids are
exact.

Skew: a history counted more than ``HOT`` times is dealt over buckets by its next word, and
the partial sums of its weight (at most tokens / ``HOT`` histories, the only thing gathered on
the driver) are added up in between. A chunk sends an n-gram once however often it holds it.

Defined cases: a null text is empty and has one token, the end; a null id is a training
document; very long texts are cut into pieces that keep their history, and are scored whole;
repeated rows are documents of their own; without training documents every token is unknown
with probability 1; an empty table gives an empty result; further columns are not read.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hashed_words, mix64, release, row_slices, shared_path, small_batches, text_bytes

ORDER = 2
CHUNK = 1 << 20            # tokens
BUCKET = 1 << 19           # tokens whose n-grams go to one bucket, about
HOT = 1 << 22              # occurrences of a history in one bucket
K = 5                      # counts that are discounted
PAD, END = np.uint64(0), np.uint64(1)            # hashes of the start and the end
UNKNOWN = (1 << 31) - 1                          # its id; the start has id 0

# Bytes of words (fixed values): all but 0x20 and 0x09-0x0D, A-Z lower-cased; 0 parts words.
LUT = np.arange(1, 257, dtype=np.uint16)
LUT[0x41:0x5B] += 32
LUT[[0x20, *range(0x09, 0x0E)]] = 0


def pack(a: np.ndarray, delta: bool = False) -> bytes:
    """An integer or float array as bytes: differences if sorted, byte planes, zstd."""
    a = np.diff(a, prepend=a.dtype.type(0)) if delta else np.ascontiguousarray(a)
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if a.dtype != np.float64 else a.tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if len(a) else b"")


def unpack(b: bytes, dtype, delta: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
    a = raw.view(dtype) if dtype == np.float64 else np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype)[:, 0]
    return np.cumsum(a, dtype=dtype) if delta else a


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes to buckets ``0 .. n - 1`` in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """``d_0 .. d_K`` from the counts of counts ``n[1] .. n[K + 1]``; ``d_0`` is not used."""
    r = np.arange(1, K + 1)
    n = np.asarray(n, np.float64)
    if (n[1:K + 2] > 0).all():
        a = (K + 1) * n[K + 1] / n[1]
        if a < 1:
            d = ((r + 1) * n[2:K + 2] / n[1:K + 1] / r - a) / (1 - a)
            if ((d > 0) & (d < 1)).all():
                return np.concatenate([[1.0], d])
    return np.concatenate([[1.0], 1 - 0.5 / r])


def ratio(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c <= K, d[np.minimum(c, K)], 1.0)


class Unigrams:
    """The lowest order, from the counts of counts: probabilities by count."""

    def __init__(self, counts_of_counts: list[int], tokens: int, types: int, docs: int):
        self.tokens, self.types, self.docs = tokens, types, docs
        self.d = discounts(np.array(counts_of_counts))
        r = np.arange(1, K + 1)
        held = float((np.array(counts_of_counts)[1:K + 1] * r * (1 - self.d[1:])).sum())
        self.scale = 1.0 if held else tokens / (tokens + 1)
        self.unknown = held / tokens if held else 1 / (tokens + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * ratio(self.d, c) * c / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


# --- chunks ------------------------------------------------------------------------------

CHUNKS = ("chunk long, key array<long>, doc array<long>, held array<boolean>, size array<int>, n_tokens long, "
          "words binary, tokens binary")


def _chunker(order: int, chunk: int):
    lead = order - 1

    def row(seq: int, pieces: list) -> pa.RecordBatch:
        key, doc, held, tokens = zip(*pieces)
        words, local = np.unique(np.concatenate(tokens), return_inverse=True)
        size = [len(t) for t in tokens]
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([seq], pa.int64()), "key": pa.array([key], pa.list_(pa.int64())),
            "doc": pa.array([doc], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())),
            "size": pa.array([size], pa.list_(pa.int32())), "n_tokens": pa.array([sum(size)], pa.int64()),
            "words": pa.array([pack(words, delta=True)], pa.binary()),
            "tokens": pa.array([pack(local.astype(np.uint32))], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 33
        seq = key = start
        pieces: list = []
        total = 0
        for b in small_batches(batches, "text"):
            data, off = text_bytes(b.column("text"))
            docs, held = b.column("doc").to_pylist(), b.column("held").to_pylist()
            for i, j in row_slices(off):
                rows, _, _, h = hashed_words(data, off[i:j + 1], LUT)
                h = np.where(h <= END, h + np.uint64(2), h)
                ends = np.searchsorted(rows, np.arange(j - i + 1))
                for r in range(j - i):
                    t = np.concatenate([np.full(lead, PAD), h[ends[r]:ends[r + 1]], [END]])
                    for a in range(0, len(t) - lead, chunk):
                        piece = t[a:a + chunk + lead]
                        if pieces and total + len(piece) > chunk:
                            yield row(seq, pieces)
                            seq, pieces, total = seq + 1, [], 0
                        pieces.append((key, docs[i + r], held[i + r], piece))
                        total += len(piece)
                    key += 1
        if pieces:
            yield row(seq, pieces)

    return run


def chunked(docs: DataFrame, id_col: str, text_col: str, held: Column, order: int, chunk: int) -> DataFrame:
    """The tokens, bucketed by chunk in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"),
                       F.coalesce(held, F.lit(False)).alias("held"))
    name = f"katz_chunks_{uuid.uuid4().hex[:12]}"
    (rows.mapInArrow(_chunker(order, chunk), CHUNKS).write.format("parquet").option("compression", "zstd")
     .option("path", shared_path(spark, "katz-chunks"))
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name))
    return spark.table(name)


# --- one chunk's view of the model ----------------------------------------------------------

class View:
    """A chunk with the answers so far: per token its id, counts and probabilities by order."""

    def __init__(self, row: dict, order: int):
        self.order, self.row = order, row
        self.size = np.array(row["size"], np.int64)
        self.words = unpack(row["words"], np.uint64, delta=True)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.piece = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(self.tokens)) - starts[self.piece]
        self.body = self.at >= order - 1
        self.train = self.body & ~np.array(row["held"], bool)[self.piece]
        self.pad = (self.words == PAD)[self.tokens]

    def unigrams(self, answers: list, uni: Unigrams) -> None:
        ids = np.concatenate([unpack(a["a"], np.int64) for a in answers])
        counts = np.concatenate([unpack(a["b"], np.int64) for a in answers])
        ids = np.where(counts > 0, ids, UNKNOWN)
        self.id = np.where(self.pad, 0, ids[self.tokens])
        self.known = counts[self.tokens]
        self.count = np.where(self.pad, uni.docs, self.known)
        self.p = uni.p(self.known)

    def grams(self, k: int, n_buckets: int, hot: int) -> None:
        """The chunk's distinct n-grams of order ``k`` with a known history, by bucket."""
        pos = np.flatnonzero((self.at >= k - 1) & np.concatenate([[False], self.count[:-1] > 0]))
        history = self.id[pos - 1] if k == 2 else self.id[pos - 2] << 32 | self.id[pos - 1]
        total, w = self.count[pos - 1], self.id[pos]
        parts = 1 + total // hot
        part = (mix64(w.astype(np.uint64)) % parts.astype(np.uint64))
        bucket = spread(mix64(mix64(history.astype(np.uint64) + np.uint64(1)) + part), n_buckets)
        order = np.lexsort((w, history, bucket))
        b, h, x = bucket[order], history[order], w[order]
        new = np.ones(len(pos), bool)
        new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        self.pos, self.gram = pos, np.empty(len(pos), np.int64)
        self.gram[order] = np.cumsum(new) - 1
        self.g_bucket, self.g_history, self.g_word = b[new], h[new], x[new]
        self.g_total, self.g_hot = total[order][new], parts[order][new] > 1
        first = np.ones(len(self.g_word), bool)
        first[1:] = (self.g_bucket[1:] != self.g_bucket[:-1]) | (self.g_history[1:] != self.g_history[:-1])
        self.h_first, self.h_of = first, np.cumsum(first) - 1

    def requests(self) -> Iterator[tuple]:
        n, train = len(self.g_word), self.train[self.pos]
        seen = np.bincount(self.gram[train], minlength=n)
        prior = np.zeros(n)
        prior[self.gram[train]] = self.p[self.pos[train]]
        for bucket, i, j in runs(self.g_bucket):
            first = np.flatnonzero(self.h_first[i:j])
            yield (bucket, pack(self.g_history[i:j][first], delta=True), pack(np.diff(first, append=j - i).astype(np.uint32)),
                   pack(self.g_hot[i:j][first].astype(np.uint8)), pack(self.g_word[i:j].astype(np.uint32)),
                   pack(seen[i:j].astype(np.uint32)), pack(prior[i:j]))

    def answered(self, answers: list, d: np.ndarray, hot: tuple) -> None:
        """Counts and probabilities of the order just asked for."""
        parts = [(unpack(a["a"], np.int64), unpack(a["b"], np.uint8), unpack(a["c"], np.int64), unpack(a["d"], np.float64))
                 for a in answers]
        c, flat, m, taken = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ([],) * 4))
        c, m = c.astype(np.int64), m.reshape(-1, K)
        n_h = int(self.h_first.sum())
        lacks = np.zeros(n_h, bool)                       # histories that back off for some n-gram
        lacks[self.h_of[c == 0]] = True
        flat = flat.astype(bool)
        all_m, all_taken = np.zeros((n_h, K), np.int64), np.zeros(n_h)
        all_m[lacks], all_taken[lacks] = m, taken
        split = self.g_hot[self.h_first]
        if split.any():
            keys, hot_m, hot_taken = hot
            i = np.searchsorted(keys, self.g_history[self.h_first][split])
            all_m[split], all_taken[split], flat[split] = hot_m[i], hot_taken[i], hot_m[i].sum(axis=1) == 0
        total = self.g_total[self.h_first]
        alpha = left_over(all_m, flat, total, d) / np.maximum(1 - all_taken, 1e-15)
        of, p = self.h_of[self.gram], self.p.copy()
        gc = c[self.gram]
        seen = np.where(flat[of], 1 / (total[of] + 1), 1 / total[of]) * ratio(d, gc) * gc
        p[self.pos] = np.where(gc > 0, seen, alpha[of] * self.p[self.pos])
        count = np.zeros(len(self.count), np.int64)
        count[self.pos] = gc
        self.count = np.where(self.pad, self.count, count)
        self.p = p


def left_over(m: np.ndarray, flat: np.ndarray, total: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The share of each history that its discounts hold back."""
    held = (m * (np.arange(1, K + 1) * (1 - d[1:]))).sum(axis=1)
    return np.where(flat, 1 / (total + 1), held / np.maximum(total, 1))


def runs(a: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, start, end)`` of each run of equal values."""
    cut = np.flatnonzero(a[1:] != a[:-1]) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(a)]):
        if j > i:
            yield int(a[i]), i, j


# --- requests, buckets and answers ----------------------------------------------------------

ASKED = "bucket long, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
ANSWERED = "kind string, chunk long, bucket long, a binary, b binary, c binary, d binary, e binary, stats array<long>"
_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in "abcdef")])
_ANSWERED = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int64()),
                       *((c, pa.binary()) for c in "abcde"), ("stats", pa.list_(pa.int64()))])


def _line(kind: str, chunk, bucket: int, blobs: tuple = (), stats: list | None = None) -> tuple:
    return kind, chunk, bucket, *blobs, *(None,) * (5 - len(blobs)), stats


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]
    release()


def _ask_words(order: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            v = View(row, order)
            seen = np.bincount(v.tokens[v.train], minlength=len(v.words))
            yield _batch([(b, row["chunk"], pack(v.words[i:j], delta=True), pack(seen[i:j].astype(np.uint32)), None, None, None, None)
                          for b, i, j in runs(spread(v.words, n_buckets))], _ASKED)

    return run


def _count_words(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = [unpack(x.as_py(), np.uint64, delta=True) for x in table.column("a")]
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("b")]).astype(np.int64)
        c = np.bincount(at, weights=seen, minlength=len(words)).astype(np.int64)
        rank = np.empty(len(c), np.int64)
        rank[np.lexsort((words, -c))] = np.arange(len(c))
        ids = rank * n_buckets + bucket + 1
        ends = np.cumsum([0, *map(len, keys)])
        out = [_line("answer", chunk, bucket, (pack(ids[at[i:j]]), pack(c[at[i:j]])))
               for chunk, i, j in zip(table.column("chunk").to_pylist(), ends[:-1], ends[1:])]
        t = c > 0
        end = int(c[words == END].sum())
        out.append(_line("table", None, bucket, (pack(words[t], delta=True), pack(ids[t]), pack(c[t]))))
        out.append(_line("stats", None, bucket, (), [*np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1:K + 2].tolist(),
                                                     int(c.sum()), int(t.sum()), end]))
        return pa.Table.from_batches([_batch(out, _ANSWERED)])

    return run


def _meet(order: int, k: int, uni: Unigrams, ratios: list, hots: list, settings: tuple):
    """A view of the chunk with all answers of orders below ``k``; settings: buckets and HOT."""
    def view(row: dict) -> View:
        v = View(row, order)
        by_order: dict[int, list] = {}
        for a in sorted(row["answers"], key=lambda a: (a["phase"], a["bucket"])):
            by_order.setdefault(a["phase"], []).append(a)
        v.unigrams(by_order[1], uni)
        for n in range(2, k):
            v.grams(n, *settings)
            v.answered(by_order.get(n, []), ratios[n], hots[n])
        return v

    return view


def _ask_grams(view, k: int, settings: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            v = view(row)
            v.grams(k, *settings)
            yield _batch([(b, row["chunk"], *blobs) for b, *blobs in v.requests()], _ASKED)

    return run


def _count_grams(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    asked = [(unpack(r["a"], np.int64, delta=True), unpack(r["b"], np.uint32).astype(np.int64), unpack(r["c"], np.uint8),
              unpack(r["d"], np.uint32).astype(np.int64), unpack(r["e"], np.uint32), unpack(r["f"], np.float64))
             for r in _rows(table.to_batches())]
    history = np.concatenate([np.repeat(x[0], x[1]) for x in asked])
    word, seen, prior = (np.concatenate([x[i] for x in asked]) for i in (3, 4, 5))
    hot = np.concatenate([np.repeat(x[2], x[1]) for x in asked])
    order = np.lexsort((word, history))
    h, w = history[order], word[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    c = np.add.reduceat(seen[order].astype(np.int64), first)
    q = np.maximum.reduceat(prior[order], first)
    h, w, hot = h[new], w[new], hot[order][new]
    h_new = np.ones(len(h), bool)
    h_new[1:] = h[1:] != h[:-1]
    of = np.cumsum(h_new) - 1
    n_h = int(h_new.sum())
    m = np.stack([np.bincount(of[c == r], minlength=n_h) for r in range(1, K + 1)], axis=1)
    t = c > 0
    taken = np.bincount(of[t], weights=q[t], minlength=n_h)
    flat = m.sum(axis=1) == 0
    out, i = [], 0
    for chunk, x in zip(table.column("chunk").to_pylist(), asked):
        g = at[i:i + len(x[3])]
        own = of[g[np.cumsum(x[1]) - x[1]]]                       # the chunk's histories, as it lists them
        lacks = np.zeros(len(own), bool)
        lacks[np.repeat(np.arange(len(own)), x[1])[c[g] == 0]] = True
        out.append(_line("answer", chunk, bucket, (pack(c[g]), pack(flat[own].astype(np.uint8)), pack(m[own[lacks]].ravel()),
                                                   pack(taken[own[lacks]]))))
        i += len(x[3])
    some = np.bincount(of[t], minlength=n_h)
    kept = some > 0
    out.append(_line("table", None, bucket, (pack(h[h_new][kept], delta=True), pack(some[kept]), pack(w[t]), pack(c[t]),
                                             pack(taken[kept]))))
    out.append(_line("stats", None, bucket, (), np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1:K + 2].tolist()))
    split = (hot[h_new] > 0) & kept
    if split.any():
        out.append(_line("hot", None, bucket, (pack(h[h_new][split], delta=True), pack(m[split].ravel()), pack(taken[split]))))
    return pa.Table.from_batches([_batch(out, _ANSWERED)])


SCORED = "key long, doc long, held boolean, n long, n_known long, base double, score double"


def _score(view, k: int, uni: Unigrams):
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("held", pa.bool_()), ("n", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            v = view(row)
            piece, n = v.piece[v.body], len(v.size)
            per = lambda x: np.bincount(piece, weights=x[v.body], minlength=n)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["key"], pa.int64()), pa.array(row["doc"], pa.int64()), pa.array(row["held"], pa.bool_()),
                pa.array(np.bincount(piece, minlength=n), pa.int64()), pa.array(per(v.known > 0).astype(np.int64)),
                pa.array(per(uni.base(v.known))), pa.array(per(np.log10(v.p)))], schema=schema)

    return run


# --- the model --------------------------------------------------------------------------------

class Katz:
    """A model of ``order`` (1 to 3) over the rows of ``docs`` that ``held`` leaves for training,
    with its tables in the shared folder, and the scores of all rows."""

    def __init__(self, docs: DataFrame, held: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, bucket: int = BUCKET, hot: int = HOT):
        if not 1 <= order <= 3:
            raise ValueError(f"order {order}: histories of at most two ids fit a key")
        self.spark, self.order = docs.sparkSession, order
        self.chunks = chunked(docs, id_col, text_col, held, order, chunk)
        n_tokens = self.chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        self.settings = (max(1, -(-n_tokens // bucket)), hot)
        self.paths: dict[int, str] = {}
        self.ratios: list = [None] * (order + 1)
        self.hots: list = [None] * (order + 1)
        asked = self.chunks.mapInArrow(_ask_words(order, self.settings[0]), ASKED)
        self._count(1, asked, _count_words(self.settings[0]))
        stats = self._stats(1, K + 4)
        self.uni = Unigrams([0, *stats[:K + 1]], *stats[K + 1:])
        self.ratios[1] = self.uni.d
        for k in range(2, order + 1):
            asked = self._met(k).mapInArrow(_ask_grams(self._view(k), k, self.settings), ASKED)
            self._count(k, asked, _count_grams)
            self.ratios[k] = discounts(np.array([0, *self._stats(k, K + 1)]))
            self.hots[k] = self._hot(k)

    def _count(self, k: int, asked: DataFrame, reduce) -> None:
        self.paths[k] = shared_path(self.spark, f"katz-{k}")
        (asked.groupBy("bucket").applyInArrow(reduce, ANSWERED).write.partitionBy("kind")
         .option("compression", "zstd").parquet(self.paths[k]))

    def _read(self, k: int, kind: str) -> DataFrame:
        rows = self.spark.read.schema(ANSWERED).parquet(self.paths[k])
        return rows.filter(F.col("kind") == kind)

    def _stats(self, k: int, n: int) -> list[int]:
        sums = self._read(k, "stats").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(n)]).first()
        return [int(x) for x in sums]

    def _hot(self, k: int) -> tuple:
        """Sums over the parts of split histories: at most tokens / HOT of them."""
        sums: dict[int, tuple] = {}
        rows = self._read(k, "hot").select("bucket", "a", "b", "c").orderBy("bucket").toLocalIterator()
        for r in rows:
            keys, m, taken = unpack(r["a"], np.int64, delta=True), unpack(r["b"], np.int64).reshape(-1, K), unpack(r["c"], np.float64)
            for key, a, b in zip(keys.tolist(), m, taken.tolist()):
                old = sums.get(key, (0, 0.0))
                sums[key] = old[0] + a, old[1] + b
        keys = np.array(sorted(sums), np.int64)
        return (keys, np.array([sums[x][0] for x in keys.tolist()], np.int64).reshape(-1, K),
                np.array([sums[x][1] for x in keys.tolist()]))

    def _view(self, k: int):
        return _meet(self.order, k, self.uni, self.ratios, self.hots, self.settings)

    def _met(self, k: int) -> DataFrame:
        """The chunks with the answers to orders below ``k``; the chunk table is not moved."""
        answers = None
        for n in range(1, k):
            a = self._read(n, "answer").select("chunk", F.struct(F.lit(n).alias("phase"), "bucket", "a", "b", "c", "d").alias("x"))
            answers = a if answers is None else answers.unionByName(a)
        return self.chunks.join(answers.groupBy("chunk").agg(F.collect_list("x").alias("answers")), "chunk")

    def scores(self) -> DataFrame:
        """``(doc, held, n, n_known, base, score)``, one row per document."""
        scored = self._met(self.order + 1).mapInArrow(_score(self._view(self.order + 1), self.order, self.uni), SCORED)
        return scored.groupBy("key").agg(F.first("doc").alias("doc"), F.first("held").alias("held"),
                                         *[F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")]).drop("key")

    def words(self) -> DataFrame:
        """The unigram table: ``(word_hash, id, count, p)``."""
        uni = self.uni

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                c = unpack(r["c"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unpack(r["a"], np.uint64, delta=True).view(np.int64)), pa.array(unpack(r["b"], np.int64)),
                                                  pa.array(c), pa.array(uni.p(c))], names=["word_hash", "id", "count", "p"])

        return self._read(1, "table").select("a", "b", "c").mapInArrow(run, "word_hash long, id long, count long, p double")

    def grams(self, k: int) -> DataFrame:
        """The table of order ``k``: ``(history, id, count)``; the history is an id, or two in the
        upper and lower 32 bits."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                h = np.repeat(unpack(r["a"], np.int64, delta=True), unpack(r["b"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(unpack(r["c"], np.int64)), pa.array(unpack(r["d"], np.int64))],
                                                 names=["history", "id", "count"])

        return self._read(k, "table").select("a", "b", "c", "d").mapInArrow(run, "history long, id long, count long")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is not learned from: crc32 of the id as text, modulo 10, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10)) == 0, F.lit(False))


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Log10 probabilities of all documents under the model of those not held out, next to the
    add-0.1 unigram baseline."""
    model = Katz(docs, held_out(), order)
    return model.scores().select(
        F.col("doc").alias("doc_id"), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), "n_known",
        F.lit(model.uni.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
