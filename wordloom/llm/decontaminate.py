"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one suffix automaton. Document words stream through it; the
state says how long the longest suffix of the words read so far is that occurs in an item.
Where that length reaches a window (10 words; a shorter item is one window as a whole), the
window's words are hit and its items noted. Spans are the unions of hit words.

The automaton only reads the stretches in which every ``GRAM`` neighbouring words occur side
by side in an item: elsewhere no window can be, so nothing is lost. That test runs on hashed
words in NumPy over the Arrow buffers; the automaton itself compares the real words.

The benchmark is split into shards of about ``SHARD_WORDS`` words, long items into pieces that
overlap, so what a task loads is bounded; the automata are built by tasks and stored. A larger
benchmark takes several passes, each adding its hits to the rows. Cuts are made on the hits of
all shards.

Defined cases: null and empty texts have no words and no hits; items without words have no
window; repeated items count by their id, once; repeated rows are judged each; an empty
benchmark hits nothing; an empty table gives an empty result; columns named like a result
column are replaced.
"""
from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_TABLE, hashed_words, materialize, mix64, small_batches, text_bytes, with_fields, word_list

WINDOW = 10
GRAM = 3
SHARD_WORDS = 200_000
PASSES_PER_WRITE = 4
MAX_COVERAGE = 0.5           # documents with a larger hit share go as a whole


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, annotated with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words]) for i, words in items if words]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # windows: state -> {length: items}; a state holds one string of each of its lengths
        self.windows: dict[int, dict[int, set[str]]] = {}
        for item, seq in seqs:
            m = min(window, len(seq))
            v = n = 0
            for c in seq:
                v, n = self.step(v, n, c)
                if n > m:                      # the state of the last m words
                    while self.length[self.link[v]] >= m:
                        v = self.link[v]
                    n = m
                if n == m:
                    self.windows.setdefault(v, {}).setdefault(m, set()).add(item)
        self.near = [-1] * len(self.next)      # nearest state with windows, itself included
        for v in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.near[v] = v if v in self.windows else self.near[self.link[v]] if v else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """The state and the longest matching length after one more word."""
        nxt = self.next
        while c not in nxt[v]:
            v = self.link[v]
            if v < 0:
                return 0, 0
            n = self.length[v]
        return nxt[v][c], n + 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges ``[start, end)``, merged, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        v = n = 0
        for i, w in enumerate(words):
            v, n = self.step(v, n, self.ids.get(w, -1))
            u = self.near[v]
            longest = 0
            while u >= 0:
                for m, items in self.windows[u].items():
                    if m <= n:
                        found |= items
                        longest = max(longest, m)
                u = self.near[self.link[u]] if u else -1
            if longest:
                if spans and i + 1 - longest <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], i + 1 - longest)
                    spans[-1][1] = i + 1
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        spans[-2][1] = spans[-1][1]
                        spans[-2][0] = min(spans[-2][0], spans[-1][0])
                        spans.pop()
                else:
                    spans.append([i + 1 - longest, i + 1])
        return [tuple(s) for s in spans], found


def _grams(h: np.ndarray, g: int) -> np.ndarray:
    out = h[:len(h) - g + 1].copy()
    for k in range(1, g):
        out = mix64(out) + h[k:len(h) - g + 1 + k]
    return out


class Shard:
    """An automaton with the filter that finds the stretches it has to read."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        words = [(i, word_list(t)) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.automaton = SuffixAutomaton(words, window)
        self.least = min((min(window, len(w)) for _, w in words), default=0)
        self.gram = min(GRAM, self.least) or 1
        keys = []
        for _, w in words:
            joined = b" ".join(w)
            _, _, _, h = hashed_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
            keys.append(_grams(h, self.gram))
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys & np.uint64((1 << 20) - 1)] = True

    def stretches(self, rows: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words, within a row, that may hold a window."""
        g, n = self.gram, len(h)
        if not len(self.keys) or n < self.least:
            return []
        k = _grams(h, g)
        ok = self.bits[k & np.uint64((1 << 20) - 1)] & (rows[:n - g + 1] == rows[g - 1:])
        at = np.flatnonzero(ok)
        if not len(at):
            return []
        near = self.keys[np.minimum(np.searchsorted(self.keys, k[at]), len(self.keys) - 1)]
        at = at[near == k[at]]
        if not len(at):
            return []
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]])
        i0 = at[new]
        i1 = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + g
        keep = i1 - i0 >= self.least
        return list(zip(i0[keep].tolist(), i1[keep].tolist()))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = "n_words long, hits array<struct<start:bigint,end:bigint>>, items array<string>"


def _pass(shard, text_col: str, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = pickle.loads(zlib.decompress(shard.value)) if shard else Shard([])
        for b in small_batches(batches, text_col):
            data, off = text_bytes(b.column(text_col))
            rows, s, e, h = hashed_words(data, off)
            n = len(off) - 1
            n_words = np.bincount(rows, minlength=n)
            base = np.concatenate([[0], np.cumsum(n_words)])
            hits: dict[int, list] = {}
            items: dict[int, set] = {}
            for i0, i1 in sh.stretches(rows, h):
                r = int(rows[i0])
                raw = data[off[r] + s[i0]:off[r] + e[i1 - 1]].tobytes().translate(WORD_TABLE).split()
                spans, found = sh.automaton.scan(raw)
                if spans:
                    at = i0 - int(base[r])
                    hits.setdefault(r, []).extend((x + at, y + at) for x, y in spans)
                    items.setdefault(r, set()).update(found)
            if carried:
                for r, (old, names) in enumerate(zip(b.column("hits").to_pylist(), b.column("items").to_pylist())):
                    if old:
                        hits.setdefault(r, []).extend((x["start"], x["end"]) for x in old)
                        items.setdefault(r, set()).update(names)
            spans = [[{"start": x, "end": y} for x, y in _merge(hits[r])] if r in hits else [] for r in range(n)]
            names = [sorted(items[r]) if r in items else [] for r in range(n)]
            keep = [c for c in b.schema.names if c not in ("n_words", "hits", "items")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(spans, SPAN),
                 pa.array(names, pa.list_(pa.string()))], names=[*keep, "n_words", "hits", "items"])

    return run


def _pieces(text: str, most: int, window: int) -> list[str]:
    """A long item in pieces of ``most`` words that overlap by ``window - 1``: every window of the
    item lies whole in a piece."""
    words, most = word_list(text), max(most, window)
    if len(words) <= most:
        return [text]
    return [b" ".join(words[i:i + most]).decode() for i in range(0, len(words) - window + 1, most - window + 1)]


def shards_of(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
              item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(shard, blob)``: the benchmark in shards of about ``shard_words`` words, their automata
    built by one task each and stored. A shard holds whole items, or pieces of long ones."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, x) for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist())
                    for k, x in enumerate(_pieces(t, shard_words, window))]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))],
                                             names=["item", "piece", "text"])

    parts = materialize(items.mapInArrow(cut, "item string, piece int, text string"), "benchmark-items")
    size = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * shard_words)))      # a word and its gap take 4 bytes or more, mostly
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item", "piece", "text"), F.lit(n)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item").to_pylist(), table.column("text").to_pylist()))
        own = Shard([(i, t.encode()) for i, t in rows], window)
        return pa.table([table.column("shard").slice(0, 1), pa.array([_pickled(own)], pa.binary())], names=["shard", "blob"])

    return materialize(dealt.select("shard", "item", "text").groupBy("shard").applyInArrow(build, "shard int, blob binary"),
                       "benchmark-shards")


def _pickled(shard: Shard) -> bytes:
    return zlib.compress(pickle.dumps(shard), 1)


class _Loaded:
    """Shards sent to the tasks one by one: the driver holds one at a time, as bytes."""

    def __init__(self, shards: DataFrame):
        self.spark, self.shards = shards.sparkSession, shards
        self.names = sorted(r["shard"] for r in shards.select("shard").collect())
        self.sent: list = []

    def send(self, k: int):
        blob = self.shards.filter(F.col("shard") == self.names[k]).first()["blob"]
        self.sent.append(self.spark.sparkContext.broadcast(bytes(blob)))
        return self.sent[-1]

    def forget(self) -> None:
        """What has been written needs its shards no more."""
        for x in self.sent:
            x.unpersist()
        self.sent = []


def _scanned(rows: DataFrame, shards: _Loaded, text_col: str, cutter=None, schema=None) -> DataFrame:
    """``rows`` with ``n_words``, ``hits`` and ``items`` over all shards; a ``cutter`` takes them in the
    last pass's own worker, to ``schema``."""
    n = max(1, len(shards.names))
    for k in range(n):
        if k and k % PASSES_PER_WRITE == 0:
            rows = materialize(rows, "decontaminate")
            shards.forget()
        one = _pass(shards.send(k) if shards.names else None, text_col, k > 0)
        if cutter and k == n - 1:
            return rows.mapInArrow(lambda batches: cutter(one(batches)), schema)
        rows = rows.mapInArrow(one, with_fields(rows.schema, ADDED))
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str], text_col: str = "text",
         window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``columns`` with ``n_words``, ``hits`` (word ranges) and ``items`` per row."""
    names = list(dict.fromkeys([*columns, text_col]))
    shards = _Loaded(shards_of(benchmark, window, shard_words))
    return _scanned(docs.select(*names), shards, text_col).select(*columns, "n_words", "hits", "items")


def n_hit(hits="hits"):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """Counts per row: words, hit words, items and their digest."""
    s = scan(docs, benchmark, [id_col], text_col, window)
    return s.select(id_col, "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.size("hits") > 0).alias("contaminated"))


def _cutter(text_col: str, chars_col: str | None, max_coverage: float):
    """Rows without their hit spans; a row cut beyond the coverage limit goes."""
    def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
        _, s, e, _ = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        parts, at = [], 0
        for x, y in spans:
            parts.append(raw[at:s[x]])
            at = int(e[y - 1])
        return b"".join([*parts, raw[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:                      # small ones, from the pass before
            hits = b.column("hits")
            hit = np.flatnonzero(hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            changed, gone = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
            total = np.array([n if t is None else t for t, n in zip(
                b.column("__total").to_pylist(), b.column("n_words").to_pylist())], np.int64)
            new: dict[str, pa.Array] = {"__total": pa.array(total, pa.int64())}
            if len(hit):
                lost = b.column("__cut").to_numpy().copy()
                texts = b.column(text_col).to_pylist()
                chars = b.column(chars_col).to_pylist() if chars_col else None
                for r in hit.tolist():
                    spans = [(x["start"], x["end"]) for x in hits[r].as_py()]
                    lost[r] += sum(y - x for x, y in spans)
                    gone[r] = lost[r] > max_coverage * total[r]
                    if gone[r]:
                        continue
                    changed[r] = True
                    texts[r] = cut(texts[r].encode(), spans).decode()
                    if chars:
                        chars[r] = len(texts[r])
                new["__cut"] = pa.array(lost, pa.int64())
                new[text_col] = pa.array(texts, b.column(text_col).type)
                if chars:
                    new[chars_col] = pa.array(chars, b.column(chars_col).type)
            names = [c for c in b.schema.names if c not in ("n_words", "hits", "items")]
            out = pa.RecordBatch.from_arrays([*(new.get(c, b.column(c)) for c in names), pa.array(changed)],
                                             names=[*names, "__changed"])
            yield out.filter(pa.array(~gone)) if gone.any() else out

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the benchmark's passages: hit spans are cut from the text (``n_chars``,
    if there, follows); a row hit in more than ``max_coverage`` of its words goes. A round cuts
    what all shards hit; rows it changed are scanned again, as what is left may form a window,
    until no shard hits. Coverage counts all rounds against the words of the text as given, so
    the shards do not show in the result."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    chars = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    shards = _Loaded(shards_of(benchmark, window, shard_words))
    left = docs.toDF(*names).withColumns({"__total": F.lit(None).cast("long"), "__cut": F.lit(0).cast("long")})
    done = None
    while done is None or left.take(1):
        seen = materialize(_scanned(left, shards, text, _cutter(text, chars, max_coverage),
                                    with_fields(left.schema, "__changed boolean")), "decontaminated")
        shards.forget()
        clean = seen.filter("not __changed").select(*names)
        done = clean if done is None else done.unionByName(clean)
        left = seen.filter("__changed").drop("__changed")
    return done.toDF(*docs.columns)
