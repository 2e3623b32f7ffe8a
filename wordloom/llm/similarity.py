"""N-gram Jaccard join by chosen paths.

A document is the set of its ``N``-word shingles. Equal sets are merged first (a node each);
a node carries a sketch of ``SKETCH`` minhash values, its set of tokens ``(position, value)``.
A run starts with all nodes in one subproblem; every node picks the tokens whose hash under
the path so far is below ``1 / (SPLIT * SKETCH)`` and moves on to the subproblem of each, so
similar sets keep meeting while others part. Subproblems of at most ``SMALL`` nodes are
compared by brute force on the sketches; one that hardly shrinks, or is deeper than
``DEPTH``, is compared in blocks, so no size is cut off. Runs are repeated until pairs at the
threshold are found with probability ``RECALL`` at the depth seen.

What the runs link loosely (sketch estimate of ``LOOSE`` or more) forms candidate groups; in
each the true Jaccard similarities of the shingle sets are computed, again in blocks, and the
links at ``THRESHOLD`` or more counted. Classes are the components of these links. Pairs are
never written: blocks return spanning edges and link counts.

Defined cases: texts of one to N-1 words are one shingle; null and empty texts and texts
without words have no shingles, no links and a class of their own; equal sets (copies) are one
node: they share class and links, and ``n_copies`` counts them; null ids belong to the class of
their text, a class without any id has a null class id; repeated ids may stand in several
classes, so ``class_key`` (the hash of one of its sets) tells classes apart, and is null for a
row without words, its own class; repeated rows are copies; an empty table gives an empty
result; further columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import hashed_words, materialize, mix64, row_slices, small_batches, text_bytes

N = 5
THRESHOLD = 0.8
SKETCH = 64
SPLIT = 0.7
SMALL = 400
DEPTH = 6
SHRINK = 0.7                 # a subproblem that keeps this share of its parent is dense
LOOSE = 0.6                  # four standard deviations below the threshold
RECALL = 0.99
RUNS = 10                    # a batch of runs: enough down to five levels
BLOCK = 1_000

_A = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, SKETCH + 1001, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted by row: ``(row, hash)``."""
    rows, _, _, h = hashed_words(data, offsets)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    g_rows, g = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) >= n:
        k = h[:len(h) - n + 1].copy()
        for i in range(1, n):
            k = mix64(k) + h[i:len(h) - n + 1 + i]
        ok = rows[:len(rows) - n + 1] == rows[n - 1:]
        g_rows, g = rows[:len(rows) - n + 1][ok], mix64(k[ok])
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        base = np.concatenate([[0], np.cumsum(words)])
        k = np.empty(len(short), np.uint64)
        for j, r in enumerate(short):
            x = np.array([words[r]], np.uint64)
            for v in h[base[r]:base[r + 1]]:
                x = mix64(x) + v
            k[j] = x[0]
        g_rows, g = np.concatenate([g_rows, short]), np.concatenate([g, mix64(k)])
    order = np.lexsort((g, g_rows))
    g_rows, g = g_rows[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (g_rows[1:] != g_rows[:-1])
    return g_rows[new], g[new]


def set_keys(rows: np.ndarray, g: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each row's set, and its size."""
    size = np.bincount(rows, minlength=n_rows)
    k1, k2 = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    at = np.flatnonzero(size)
    if len(at):
        start = np.concatenate([[0], np.cumsum(size[at])[:-1]])
        k1[at] = np.add.reduceat(mix64(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
        k2[at] = np.add.reduceat(mix64(g + np.uint64(0x1234567)), start)
    return k1, k2, size


def sketches(rows: np.ndarray, g: np.ndarray, n_rows: int) -> np.ndarray:
    size = np.bincount(rows, minlength=n_rows)
    out = np.zeros((n_rows, SKETCH), np.uint32)
    at = np.flatnonzero(size)
    if len(at):
        start = np.concatenate([[0], np.cumsum(size[at])[:-1]])
        for k in range(SKETCH):
            out[at, k] = np.minimum.reduceat(((g * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def _sketcher():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            data, off = text_bytes(b.column("text"))
            n = len(off) - 1
            k1, k2, size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
            sk = np.zeros((n, SKETCH), np.uint32)
            for i, j in row_slices(off):
                rows, g = shingle_sets(data, off[i:j + 1])
                k1[i:j], k2[i:j], size[i:j] = set_keys(rows, g, j - i)
                sk[i:j] = sketches(rows, g, j - i)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SKETCH), n, [None, pa.py_buffer(sk.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size),
                 raw.cast(pa.binary())], names=["doc_id", "text_hash", "k1", "k2", "n_set", "sketch"])
    return run


def _sketch_matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, off = text_bytes(column)
    return data[off[0]:off[-1]].view(np.uint32).reshape(-1, SKETCH) if len(column) else np.zeros((0, SKETCH), np.uint32)


def _splitter(roots: np.ndarray | None):
    """Rows ``(path, size, node, sketch)`` to their child subproblems; with ``roots``, each row
    enters every run's root."""
    limit = np.uint64(int(2 ** 64 / (SPLIT * SKETCH)))
    position = mix64(np.arange(2001, SKETCH + 2001, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk = _sketch_matrix(b.column("sketch"))
            node = b.column("node").to_numpy()
            token = mix64(sk.astype(np.uint64) + position)
            for root in (roots if roots is not None else [None]):
                if root is None:
                    path = b.column("path").to_numpy().view(np.uint64)
                    parent = b.column("size").to_numpy()
                else:
                    path, parent = np.full(len(node), root, np.uint64), np.full(len(node), -1, np.int64)
                pick = mix64(token ^ mix64(path)[:, None])
                r, c = np.nonzero(pick < limit)
                child = mix64(pick[r, c] + path[r])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(parent[r], pa.int64()), pa.array(node[r])],
                    names=["path", "parent", "node"])
    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < at_least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left")) if k[0] != k[-1] else 0
        if cut:
            yield t.slice(0, cut)
            rest = t.slice(cut)
            held, n = rest.combine_chunks().to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row, root row) that span the components of a symmetric boolean matrix."""
    m = len(near)
    root = np.arange(m)
    left = np.ones(m, bool)
    for i in range(m):
        if not left[i]:
            continue
        reach = front = np.zeros(m, bool)
        reach[i] = True
        front = reach.copy()
        while front.any():
            grown = near[front].any(axis=0) & left & ~reach
            reach |= grown
            front = grown
        root[reach] = i
        left &= ~reach
    at = np.flatnonzero(root != np.arange(m))
    return at, root[at]


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch comparison inside subproblems (rows sorted by path) to loose star edges."""
    for t in whole_groups(batches, "path"):
        path, node, sk = t.column("path").to_numpy(), t.column("node").to_numpy(), _sketch_matrix(t.column("sketch"))
        start = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        size = np.diff(np.append(start, len(path)))
        us, vs = [], []
        two = start[size == 2]
        near = (sk[two] == sk[two + 1]).mean(axis=1) >= LOOSE
        us.append(node[two][near])
        vs.append(node[two + 1][near])
        for s, m in zip(start[size > 2], size[size > 2]):
            x = sk[s:s + m]
            same = np.zeros((m, m), np.int16)
            for k in range(SKETCH):
                same += x[:, k][:, None] == x[:, k][None, :]
            a, b = spanning(same >= LOOSE * SKETCH)
            us.append(node[s + a])
            vs.append(node[s + b])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def blocked(rows: DataFrame, key: str, size: str, unit: str, block: int) -> DataFrame:
    """Rows of groups beyond ``block`` are dealt over the pairs of the group's blocks: adds
    ``__i``, ``__j`` (the pair) and ``__b`` (the row's block). Groups within it stay whole."""
    nb = F.greatest(F.ceil(F.col(size) / F.lit(block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(unit), nb).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), nb - 1))
    return (rows.withColumn("__b", own).withColumn("__o", pairs)
            .withColumn("__i", F.least("__b", "__o")).withColumn("__j", F.greatest("__b", "__o")).drop("__o"))


def recall_at(depth: int, runs: int, threshold: float = THRESHOLD) -> float:
    """Chance that a pair at the threshold shares a subproblem of this depth in some run."""
    common, q = threshold / SPLIT, 1.0
    for _ in range(depth):
        q = 1 - math.exp(-common * q)
    return 1 - (1 - q) ** runs


def chosen_path_edges(nodes: DataFrame, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """Loose candidate edges ``(u, v)`` between the nodes ``(node, sketch)``."""
    found: list[DataFrame] = []
    done, depth = 0, 1
    while done == 0 or recall_at(depth, done) < recall:
        roots = mix64(np.arange(done, done + RUNS, dtype=np.uint64) + np.uint64(seed * 1_000_003))
        rows = nodes.mapInArrow(_splitter(roots), "path long, parent long, node long")
        for level in range(1, DEPTH + 1):
            sizes = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
            met = materialize(rows.join(sizes.hint("merge"), "path"), "path-groups")
            dense = (F.col("parent") > 0) & (F.col("size") > SHRINK * F.col("parent")) | F.lit(level == DEPTH)
            small = met.filter(F.col("size") <= SMALL)
            large = met.filter(F.col("size") > SMALL)
            dealt = blocked(large.filter(dense), "path", "size", "node", BLOCK)
            found.append(small.select("path", "node").unionByName(
                dealt.select(F.xxhash64("path", "__i", "__j").alias("path"), "node")))
            go = large.filter(~dense)
            if not go.take(1):
                break
            depth = max(depth, level + 1)
            rows = go.join(nodes.hint("merge"), "node").select("path", "size", "node", "sketch").mapInArrow(
                _splitter(None), "path long, parent long, node long")
        done += RUNS
    leaf = found[0]
    for f in found[1:]:
        leaf = leaf.unionByName(f)
    # one pass over all subproblems of all levels; by sort-merge whatever the sizes, so the
    # plan does not change as tables grow
    leaf = leaf.join(nodes.hint("merge"), "node").repartition("path").sortWithinPartitions("path", "node")
    return materialize(leaf.mapInArrow(_brute, "u long, v long").distinct(), "loose")


def jaccard_links(rows: np.ndarray, g: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets with Jaccard similarity at the threshold or above."""
    size = np.bincount(rows, minlength=n).astype(np.float64)
    order = np.argsort(g, kind="stable")
    r, k = rows[order], g[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1 if len(col) else np.zeros(0, bool)
    r, col = r[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    both = np.zeros((n, n), np.float64)
    width = max(256, 8_000_000 // max(n, 1))
    total = int(often.sum())
    for lo in range(0, total, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        a = np.zeros((n, min(width, total - lo)), np.float32)
        a[r[i:j], col[i:j] - lo] = 1
        both += a @ a.T
    either = size[:, None] + size[None, :] - both
    near = both >= threshold * either - 1e-9
    near[size == 0] = near[:, size == 0] = False
    np.fill_diagonal(near, False)
    return near


def _verifier(threshold: float):
    """Texts sorted by group to ``(node, root, n_links)``; a group is one pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "part", 500):
            part = t.column("part").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            nodes, roots, links, split = [], [], [], []
            for s, e in zip(start, np.append(start[1:], len(part))):
                own = t.slice(s, e - s)
                node, block = own.column("node").to_numpy(), own.column("block").to_numpy()
                data, off = text_bytes(own.column("text"))
                rows, g = shingle_sets(data, off)
                k1, k2, size = set_keys(rows, g, len(node))
                # a text of the same hash may be another one; and one text is enough
                want1, want2 = own.column("k1").to_numpy(), own.column("k2").to_numpy()
                right = (k1.view(np.int64) == want1) & (k2.view(np.int64) == want2)
                first = np.zeros(len(node), bool)
                first[np.unique(np.where(right, node, np.iinfo(np.int64).min), return_index=True)[1]] = True
                use = np.flatnonzero(right & first)
                place = np.full(len(node), -1)
                place[use] = np.arange(len(use))
                ok = place[rows] >= 0
                near = jaccard_links(place[rows[ok]], g[ok], len(use), threshold)
                node, block = node[use], block[use]
                i, j = own.column("i")[0].as_py(), own.column("j")[0].as_py()
                if i != j:                  # only pairs across the two blocks are counted here
                    counted = near & (block[:, None] != block[None, :])
                else:
                    counted = near
                a, b = spanning(counted)
                root = node.copy()
                root[a] = node[b]
                nodes.append(node)
                roots.append(root)
                links.append(counted.sum(axis=1))
                split.append(np.full(len(node), own.column("split")[0].as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots)),
                 pa.array(np.concatenate(links).astype(np.int64)), pa.array(np.concatenate(split))],
                names=["node", "root", "n_links", "split"])
    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL) -> DataFrame:
    """``(doc_id, class_id, class_key, n_links, n_copies)`` for every row: the smallest id of its
    class, the class itself, how many other texts (shingle sets) are linked to it, and how many
    rows share its set."""
    return _classes(docs, id_col, text_col, threshold, recall).drop("text_hash")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    """``join`` with the hash of the row's text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    sk = materialize(own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _sketcher(), f"doc_id {kind}, text_hash long, k1 long, k2 long, n_set long, sketch binary"), "sketches")
    sk = sk.withColumn("node", F.xxhash64("k1", "k2"))
    # a node's text is read at its first (id, text), which ``n_rows`` rows share
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n_rows")).alias("first")
    nodes = (sk.filter("n_set > 0").groupBy("node", "doc_id", "text_hash").agg(
        F.count("*").alias("n_rows"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("sketch").alias("sketch"))
        .groupBy("node").agg(first, F.sum("n_rows").alias("n_copies"), F.first("k1").alias("k1"),
                             F.first("k2").alias("k2"), F.first("sketch").alias("sketch")))
    nodes = materialize(nodes.select("node", "first.doc_id", "first.text_hash", "first.n_rows", "n_copies", "k1", "k2", "sketch"),
                        "nodes")
    loose = chosen_path_edges(nodes.select("node", "sketch"), recall)
    groups = components(loose, "loose-components")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    cand = groups.join(sizes, "root").join(nodes.select("node", "doc_id", "text_hash", "n_rows", "k1", "k2"), "node")
    cand = materialize(cand, "candidates")
    texts = own.withColumnRenamed("doc_id", "__id").join(
        cand.hint("merge"), F.col("__id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_hash")), "inner")
    if cand.filter("n_rows > 1").take(1):
        texts = texts.filter("n_rows = 1").unionByName(texts.filter("n_rows > 1").dropDuplicates(["node"]))
    dealt = blocked(texts, "root", "size", "node", BLOCK)
    parts = (dealt.select(F.xxhash64("root", "__i", "__j").alias("part"), "node", F.col("__b").alias("block"),
                          F.col("__i").alias("i"), F.col("__j").alias("j"), (F.col("size") > BLOCK).alias("split"),
                          "k1", "k2", "text")
             .repartition("part").sortWithinPartitions("part", "node"))
    linked = materialize(parts.mapInArrow(_verifier(threshold), "node long, root long, n_links long, split boolean"), "links")
    # a group compared as a whole has its classes; only split groups' edges are still to be joined
    classes = linked.filter("not split and node <> root").select("node", "root")
    if linked.filter("split and node <> root").take(1):
        classes = classes.unionByName(components(
            linked.filter("split").select(F.col("node").alias("u"), F.col("root").alias("v")), "link-components"))
    degree = linked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    named = (nodes.select("node", "doc_id", "n_copies").join(classes, "node", "left").join(degree, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = materialize(named.join(ids, "root").select("node", "class_id", F.col("root").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                                                       "n_copies"), "classes")
    rest = sk.filter("n_set > 0").select("doc_id", "text_hash", "node").join(named, "node")
    cols = [F.col("doc_id").alias(id_col), "text_hash", "class_id", "class_key", "n_links", "n_copies"]
    empty = sk.filter("n_set = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"),
                                          F.lit(None).cast("long").alias("class_key"), F.lit(0).cast("long").alias("n_links"),
                                          F.lit(1).cast("long").alias("n_copies"))
    return rest.select(*cols).unionByName(empty.select(*cols))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, rows without one last, then
    of the smallest text hash; of equal rows one stays. Rows without words all stay."""
    rows = _classes(docs, id_col, text_col, threshold, RECALL).select(
        F.col(id_col).alias("__id"), F.col("text_hash").alias("__t"), F.col("class_key").alias("__class"))
    pick = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__t", "n")).alias("pick")
    keep = (rows.filter("__class is not null").groupBy("__class", "__id", "__t").agg(F.count("*").alias("n"))
            .groupBy("__class").agg(pick).select("__class", "pick.__id", "pick.__t", "pick.n"))
    blank = rows.filter("__class is null").select("__class", "__id", "__t", F.lit(1).cast("long").alias("n")).distinct()
    keep = materialize(keep.unionByName(blank), "kept-ids")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__t"))
    kept = docs.join(keep.filter("n = 1"), same, "left_semi")
    again = docs.join(keep.filter("n > 1"), same).dropDuplicates(["__class"]).select(*docs.columns)
    return kept.unionByName(again)
