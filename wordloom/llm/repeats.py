"""Suffix-array deduplication by the common-prefix interval tree.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier (smaller doc_id, or
the same document and an earlier start) is removed. The suffix array is sparse and sharded: it
holds the suffixes at content-chosen anchors (``anchors``), of which every string of that
length has one at the same place in each of its occurrences, and suffixes with one first gram
go to one shard. There

1. occurrences of one whole context (all strings around the anchor) are told apart by a hash;
   all but the first are covered as a whole. Each input batch does this first, so of a hot
   context only a row per batch is shuffled;
2. anchors with several contexts bring their bytes: the suffixes are sorted, a stack scan of
   the neighbours' common prefixes yields the interval tree, and in each interval the same scan
   over the reversed left sides splits the members where their left extensions differ. Each
   (prefix interval, left interval) of ``LENGTH`` bytes or more is a maximal repeat with all its
   occurrences; all but the first lose that span. Groups of more than ``HOT`` contexts are
   dealt by each string's own hash instead, which needs no group in one task.

A document is a row: it is numbered once (``tie``) in the order of doc_id, nulls last, and a
64-bit hash of its text.

Defined cases: null texts are empty; texts below ``LENGTH`` bytes keep everything; rows with
one doc_id are ordered by a hash of their text, rows without one come last; rows equal in both
are documents of their own, of which one comes first; an empty table gives an empty result;
further columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import LEFT, LENGTH, text_anchors
from .shared import _powers, materialize, text_bytes
from .similarity import whole_groups

SHARD_BYTES = 32_000_000     # text a shard stands for
HOT = 100_000                # contexts of one gram
LAST = (1 << 63) - 1         # order of rows without an id

PACK = np.dtype([("h", "<u8"), ("c", "<u8"), ("row", "<u4"), ("pos", "<u4")])
COVER = "doc long, tie long, whole binary, spans binary, edges binary, hot binary"
EDGE = np.dtype([("h", "<u8"), ("pos", "<u4")])


def _by_document(doc, tie, values: np.ndarray, kind: str, names: list[str], order: np.ndarray | None = None):
    """A row per document with its values as one binary of column ``kind``."""
    if order is None:
        order = np.lexsort((tie, doc))
    doc, tie, values = doc[order], tie[order], values[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])) if len(doc) else []
    ends = np.append(cut[1:], len(doc)) if len(doc) else []
    packed = [values[a:b].tobytes() for a, b in zip(cut, ends)]
    cols = {"doc": pa.array(doc[cut] if len(doc) else [], pa.int64()), "tie": pa.array(tie[cut] if len(doc) else [], pa.int64())}
    none = pa.nulls(len(packed), pa.binary())
    return pa.RecordBatch.from_arrays(
        [cols.get(n, pa.array(packed, pa.binary()) if n == kind else none) for n in names], names=names)


def _firsts(h, c, doc, tie, pos):
    """Order by (gram, context, document, position); which rows are not their context's first."""
    order = np.lexsort((pos, tie, doc, c, h))
    h, c = h[order], c[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    new_c = new_h.copy()
    new_c[1:] |= c[1:] != c[:-1]
    d, t, p = doc[order], tie[order], pos[order]
    same = np.zeros(len(h), bool)        # one place seen twice is no repeat
    same[1:] = ~new_c[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])
    first = np.zeros(len(h), np.int64)
    first[new_c] = np.flatnonzero(new_c)
    first = np.maximum.accumulate(first) if len(h) else first
    own = (d == d[first]) & (t == t[first]) & (p == p[first])
    return order, new_h, new_c, ~own & ~same, same


def _sampler(n_shards: int):
    """Texts to packed anchors by shard, and to what the batch alone shows to be covered."""
    names = ["shard", "head", "packed", "doc", "tie", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers()
        for b in batches:
            doc, tie = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            rows, pos, hs, cs = [], [], [], []
            for r, x in enumerate(_unpress(b)):
                at, h, c = text_anchors(x, up, down)
                if len(at):
                    rows.append(np.full(len(at), r, np.int64))
                    pos.append(at)
                    hs.append(h)
                    cs.append(c)
            if not rows:
                continue
            row, p, h, c = (np.concatenate(x) for x in (rows, pos, hs, cs))
            order, _, new_c, later, _ = _firsts(h, c, doc[row], tie[row], p)
            gone = order[later]
            if len(gone):
                t = _by_document(doc[row[gone]], tie[row[gone]], p[gone].astype("<u4"), "whole", ["doc", "tie", "whole"])
                none = [pa.nulls(t.num_rows, k) for k in (pa.binary(), pa.binary())]
                shard = pa.array(np.arange(t.num_rows) % n_shards, pa.int32())
                yield pa.RecordBatch.from_arrays([shard, *none, *t.columns], names=names)
            keep = order[new_c]
            shard = (h[keep] % np.uint64(n_shards)).astype(np.int64)
            by = np.lexsort((row[keep], shard))
            keep, shard = keep[by], shard[by]
            cut = np.searchsorted(shard, np.arange(n_shards + 1))
            out = []
            for s in range(n_shards):
                own = keep[cut[s]:cut[s + 1]]
                if not len(own):
                    continue
                used, local = np.unique(row[own], return_inverse=True)
                a = np.empty(len(own), PACK)
                a["h"], a["c"], a["row"], a["pos"] = h[own], c[own], local, p[own]
                head = np.stack([doc[used], tie[used]]).astype("<i8")
                out.append((s, head.tobytes(), b"".join(a[k].tobytes() for k in PACK.names)))
            cols = list(zip(*out))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
    return run


SAMPLED = "shard int, head binary, packed binary, doc long, tie long, whole binary"
NAMES = ["doc", "tie", "whole", "spans", "edges", "hot"]


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // PACK.itemsize
    a = np.empty(n, PACK)
    at = 0
    for k in PACK.names:
        size = PACK[k].itemsize * n
        a[k] = np.frombuffer(raw, PACK[k], count=n, offset=at)
        at += size
    return a


def _shard_scan(most: int):
    """Shards to covered anchors, and to the anchors whose bytes are needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard", 1):
            through = t.filter(pa.compute.is_valid(t.column("whole")))
            for b in through.to_batches():
                none = pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tie"), b.column("whole"), none, none, none],
                                                 names=NAMES)
            t = t.filter(pa.compute.is_valid(t.column("packed")))
            if not t.num_rows:
                continue
            parts, docs, ties = [], [], []
            for head, packed in zip(t.column("head"), t.column("packed")):
                a = _unpack(packed.as_py())
                d = np.frombuffer(head.as_py(), "<i8").reshape(2, -1)
                parts.append(a)
                docs.append(d[0][a["row"]])
                ties.append(d[1][a["row"]])
            a, doc, tie = np.concatenate(parts), np.concatenate(docs), np.concatenate(ties)
            order, new_h, new_c, later, _ = _firsts(a["h"], a["c"], doc, tie, a["pos"])
            gone = order[later]
            if len(gone):
                yield _by_document(doc[gone], tie[gone], a["pos"][gone], "whole", NAMES)
            group = np.cumsum(new_h) - 1
            contexts = np.bincount(group, weights=new_c).astype(np.int64)
            several = new_c & (contexts[group] > 1)
            hot = contexts[group] > most
            for kind, edge in (("edges", order[several & ~hot]), ("hot", order[several & hot])):
                if len(edge):
                    e = np.empty(len(edge), EDGE)
                    e["h"], e["pos"] = a["h"][edge], a["pos"][edge]
                    yield _by_document(doc[edge], tie[edge], e, kind, NAMES)
    return run


CONTEXT = "h long, doc long, tie long, pos int, left binary, right binary"
WINDOW_ROW = "w1 long, w2 long, doc long, tie long, pos int"


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: a shuffle of texts moves and stores less."""
    for b in batches:
        data, off = text_bytes(b.column("text"))
        small = [pa.compress(pa.py_buffer(data[i:j]), "zstd", asbytes=True) for i, j in zip(off[:-1], off[1:])]
        at = b.schema.names.index("text")
        cols = [*b.columns[:at], pa.array(small, pa.binary()), *b.columns[at + 1:], pa.array(np.diff(off), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "n"])


def _unpress(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for small, n in zip(b.column("text"), b.column("n").to_pylist()):
        yield np.frombuffer(pa.decompress(small.as_buffer(), n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)


def _contexts(hot: bool):
    """Texts with their anchors in question to the bytes around each (``hot``: to the hash of
    every string around each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tie = b.column("doc").to_numpy(), b.column("tie").to_numpy()
            cols: list[list] = [[] for _ in range(6)]
            for r, (raw, x) in enumerate(zip(b.column("edges"), _unpress(b))):
                for one in raw.as_py():
                    e = np.frombuffer(one, EDGE)
                    for h, p in zip(e["h"].view(np.int64).tolist(), e["pos"].tolist()):
                        if hot:
                            for s in range(max(0, p - LEFT), min(p, len(x) - LENGTH) + 1):
                                k = hashlib.blake2b(x[s:s + LENGTH].tobytes(), digest_size=16).digest()
                                for c, v in zip(cols, (int.from_bytes(k[:8], "little", signed=True),
                                                       int.from_bytes(k[8:], "little", signed=True), doc[r], tie[r], s)):
                                    c.append(v)
                        else:
                            for c, v in zip(cols, (h, doc[r], tie[r], p, x[max(0, p - LEFT):p][::-1].tobytes(),
                                                   x[p:p + LENGTH].tobytes())):
                                c.append(v)
            types = ((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()) if hot else
                     (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))
            names = [f.split()[0] for f in (WINDOW_ROW if hot else CONTEXT).split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    return run


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the rows of two byte matrices, ``most`` at most."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, most)


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """The common-prefix interval tree by a stack scan: ``(length, first, last)`` of every
    interval of ``least`` or more, inner ones first."""
    out, stack = [], []
    for i, v in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            if length >= least:
                out.append((length, first, i))
        if not stack or stack[-1][0] < v:
            stack.append((v, first))
    return out


def _matrix(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width)
    return m, size


def maximal_repeats(left: list[bytes], right: list[bytes], length: int = LENGTH):
    """Maximal repeats among suffixes with their reversed left sides: ``(left, right, members)``,
    the bytes shared before and after the anchor and every member that shares them."""
    L, ll = _matrix(left, LEFT)
    R, rl = _matrix(right, LENGTH)
    # a shorter side sorts before its extensions; the length breaks ties with real zero bytes
    order = np.array(sorted(range(len(right)), key=right.__getitem__))
    lcp = common(R[order[:-1]], R[order[1:]], np.minimum(rl[order[:-1]], rl[order[1:]])).tolist()
    out = []
    for after, i, j in intervals(lcp, length - LEFT):
        own = order[i:j + 1]
        if len(own) == 2:
            a, b = own
            before = int(common(L[a:a + 1], L[b:b + 1], np.minimum(ll[a:a + 1], ll[b:b + 1]))[0])
            if before + after >= length:
                out.append((before, after, own))
            continue
        own = np.array(sorted(own.tolist(), key=left.__getitem__))
        lcs = common(L[own[:-1]], L[own[1:]], np.minimum(ll[own[:-1]], ll[own[1:]])).tolist()
        for before, x, y in intervals(lcs, length - after):       # left extensions differ here
            out.append((before, after, own[x:y + 1]))
    return out


def _interval_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of whole grams to removed spans."""
    for t in whole_groups(batches, "h"):
        key = [t.column(c).to_numpy() for c in ("pos", "tie", "doc", "h")]
        order = np.lexsort(key)              # of a place seen twice one stays
        new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)])
        t = t.take(pa.array(np.sort(order[new])))
        h, doc, tie, pos = (t.column(c).to_numpy() for c in ("h", "doc", "tie", "pos"))
        left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
        place = np.empty(len(h), np.int64)
        place[np.lexsort((pos, tie, doc))] = np.arange(len(h))
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        rows, lo, hi = [], [], []
        two = start[size == 2]
        if len(two):                      # the commonest tree: one interval of two members
            L, ll = _matrix([left[i] for k in two for i in (k, k + 1)], LEFT)
            R, rl = _matrix([right[i] for k in two for i in (k, k + 1)], LENGTH)
            before = common(L[::2], L[1::2], np.minimum(ll[::2], ll[1::2]))
            after = common(R[::2], R[1::2], np.minimum(rl[::2], rl[1::2]))
            ok = before + after >= LENGTH
            later = np.where(place[two] > place[two + 1], two, two + 1)[ok]
            rows.append(later)
            lo.append(pos[later] - before[ok])
            hi.append(pos[later] + after[ok])
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            best: dict[int, list] = {}
            for before, after, own in maximal_repeats(left[s:s + m], right[s:s + m]):
                own = own + s
                keep = own[np.argmin(place[own])]
                for r in own.tolist():
                    if r != keep and not any(before <= x and after <= y for x, y in best.get(r, ())):
                        best.setdefault(r, []).append((before, after))
            for r, spans in best.items():
                rows.append(np.full(len(spans), r))
                lo.append(np.array([pos[r] - x for x, _ in spans]))
                hi.append(np.array([pos[r] + y for _, y in spans]))
        if rows:
            r = np.concatenate(rows)
            spans = np.stack([np.concatenate(lo), np.concatenate(hi)], axis=1).astype("<u4")
            yield _by_document(doc[r], tie[r], spans, "spans", NAMES)


def merged(whole: list[bytes], spans: list[bytes], n: int) -> np.ndarray:
    """Maximal removed runs ``(start, end)`` of a text of n bytes."""
    p = np.frombuffer(b"".join(whole), "<u4").astype(np.int64)
    s = np.frombuffer(b"".join(spans), "<u4").astype(np.int64).reshape(-1, 2)
    lo = np.concatenate([np.maximum(p - LEFT, 0), s[:, 0]])
    hi = np.concatenate([np.minimum(p + LENGTH, n), s[:, 1]])
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return np.stack([lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]], axis=1)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(texts, covers)``: the keyed texts ``(id, doc, tie, text, n)``, compressed, and per
    document what of it is covered (``whole`` anchors and ``spans``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"),
                        F.xxhash64(text).alias("hash"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    kind = keyed.schema["id"].dataType.simpleString()
    pressed = keyed.mapInArrow(_press, f"id {kind}, doc long, hash long, text binary, n long")
    # the last key only lets equal rows lie in several tasks
    pressed = pressed.withColumn("any", F.monotonically_increasing_id()).sort("doc", "hash", "any").select(
        "id", "doc", F.monotonically_increasing_id().alias("tie"), "text", "n")
    pressed = materialize(pressed, "repeat-texts")
    sampled = pressed.select("doc", "tie", "text", "n").mapInArrow(_sampler(n_shards), SAMPLED)
    shards = sampled.repartition(n_shards, "shard").sortWithinPartitions("shard")
    first = materialize(shards.mapInArrow(_shard_scan(hot), COVER), "repeat-shards")

    def asked(kind: str) -> DataFrame:
        per = first.filter(F.col(kind).isNotNull()).groupBy("doc", "tie").agg(F.collect_list(kind).alias("edges"))
        return pressed.select("doc", "tie", "text", "n").join(per, ["doc", "tie"])

    near = asked("edges").mapInArrow(_contexts(False), CONTEXT).repartition("h").sortWithinPartitions("h")
    covers = first.filter("whole is not null").unionByName(materialize(near.mapInArrow(_interval_tree, COVER), "repeat-tree"))
    if first.filter("hot is not null").take(1):
        strings = materialize(asked("hot").mapInArrow(_contexts(True), WINDOW_ROW).distinct(), "repeat-strings")
        firsts = (strings.groupBy("w1", "w2").agg(F.min(F.struct("doc", "tie", "pos")).alias("first"), F.count("*").alias("n"))
                  .filter("n > 1").drop("n"))
        later = strings.join(firsts, ["w1", "w2"]).filter(F.struct("doc", "tie", "pos") != F.col("first"))
        covers = covers.unionByName(later.select("doc", "tie", "pos").mapInArrow(_string_spans, COVER))
    return pressed, covers


def _string_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, tie, pos = (b.column(c).to_numpy() for c in ("doc", "tie", "pos"))
        yield _by_document(doc, tie, np.stack([pos, pos + LENGTH], axis=1).astype("<u4"), "spans", NAMES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for whole, spans, x in zip(b.column("whole").to_pylist(), b.column("spans").to_pylist(), _unpress(b)):
            runs = merged(whole or [], spans or [], len(x))
            kept, at = hashlib.sha256(), 0
            for s, e in runs.tolist():
                kept.update(x[at:s].tobytes())
                at = e
            kept.update(x[at:].tobytes())
            out.append((len(x), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest()))
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row."""
    keyed, covers = removed_spans(docs, id_col, text_col, hot)
    per = covers.groupBy("doc", "tie").agg(F.collect_list("whole").alias("whole"), F.collect_list("spans").alias("spans"))
    kind = keyed.schema["id"].dataType.simpleString()
    rows = keyed.join(per, ["doc", "tie"], "left").select("id", "text", "n", "whole", "spans")
    return rows.mapInArrow(_digest, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                           ).withColumnRenamed("id", id_col)
