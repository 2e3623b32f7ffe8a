"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most ``SAMPLE`` vectors (lowest hashes of vec_id) by spherical
k-means, ``BRANCH`` children a node, until a leaf stands for ``LEAF`` rows or has fewer than
``MIN_SPLIT`` sample vectors. Every row is put into the leaf its vector descends to. A query
walks the tree with a priority queue, nearest branch first, and names the leaves it visits.
Neighbouring leaves of about ``PART`` rows together form a bin; queries and rows meet by bin,
where a query sees the rows of its own leaves only. How many leaves are visited is calibrated: the exact neighbours
of ``CALIBRATION`` queries are found by one pass over all rows, and visits widen until those
queries reach ``RECALL`` (at worst all leaves: then the search is exact).

Large bins are split on both sides: rows by a hash into parts of ``PART`` rows, queries into
parts of ``QUERY_PART``; each pair of parts is a group of bounded size. Of rows with one and
the same vector only those of the k + 1 smallest ids can be among k neighbours, so the others
leave before the search (they stay queries).

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without vec_id; vectors of several dimensions are searched among their own
dimension each, as no cosine joins them; rows that share the query's vec_id are its own;
repeated query ids are answered once, by the least of their vectors; ties go to the smaller vec_id;
fewer than k candidates are all returned; an empty table gives an empty result.
"""
from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SAMPLE, LEAF, BRANCH, MIN_SPLIT = 20_000, 200, 8, 40
CALIBRATION, RECALL = 200, 0.95
PART, QUERY_PART = 20_000, 5_000


class Tree:
    """Nodes in arrays: ``children[i]`` are node numbers, none for a leaf."""

    def __init__(self, x: np.ndarray, n_rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre, self.children, self.leaf_of, self.leaves = [], [], [], []
        want = max(1, n_rows / LEAF)                    # leaves
        self._grow(x, max(MIN_SPLIT, 2 * len(x) / want), rng)
        self.centre = np.array(self.centre, dtype=np.float64)

    def _node(self, centre: np.ndarray) -> int:
        self.centre.append(centre)
        self.children.append(np.zeros(0, np.int64))
        self.leaf_of.append(-1)
        return len(self.centre) - 1

    def _grow(self, x: np.ndarray, most: float, rng) -> None:
        todo = [(self._node(x.mean(axis=0)), x)]
        while todo:
            node, own = todo.pop()
            k = min(BRANCH, int(len(own) // (MIN_SPLIT // 4)))
            label = _spherical(own, k, rng) if len(own) > most and k > 1 else None
            if label is None or len(np.unique(label)) < 2:
                self.leaf_of[node] = len(self.leaves)
                self.leaves.append(node)
                continue
            kids = []
            for c in np.unique(label):
                part = own[label == c]
                m = part.mean(axis=0)
                kid = self._node(m / max(np.linalg.norm(m), 1e-12))
                kids.append(kid)
                todo.append((kid, part))
            self.children[node] = np.array(kids)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each unit vector descends to."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x)) if len(self.children[0]) else np.zeros(0, np.int64)
        while len(moving):
            nodes = at[moving]
            for node in np.unique(nodes):
                rows = moving[nodes == node]
                kids = self.children[node]
                at[rows] = kids[np.argmax(x[rows] @ self.centre[kids].T, axis=1)]
            moving = moving[[len(self.children[n]) > 0 for n in at[moving]]]
        return np.array([self.leaf_of[n] for n in at], np.int64)

    def visit(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves in best-bin-first order."""
        out: list[int] = []
        queue: list[tuple[float, int]] = [(-1.0, 0)]
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            while len(self.children[node]):
                kids = self.children[node]
                near = self.centre[kids] @ q
                best = int(np.argmax(near))
                for i, kid in enumerate(kids.tolist()):
                    if i != best:
                        heapq.heappush(queue, (-float(near[i]), kid))
                node = int(kids[best])
            out.append(self.leaf_of[node])
        return out


def _spherical(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = np.argmax(x @ centre.T, axis=1)
        if (new == label).all() and _:
            break
        label = new
        for c in range(k):
            own = x[label == c]
            if len(own):
                m = own.mean(axis=0)
                centre[c] = m / max(np.linalg.norm(m), 1e-12)
    return label


def usable(vector: str = "embedding") -> Column:
    """Not null, finite throughout and not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True) if x.size else 1.0
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; equal rows give equal results wherever they lie."""
    dot = (q * v).sum(axis=-1)
    return dot / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((v * v).sum(axis=-1)))


def _nearest(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, seen=None):
    """``(query_id, row, score)`` of each query's k nearest rows, ties to the smaller id;
    ``seen(i, j)`` masks the rows that queries i..j visit."""
    out_q, out_row, out_s = [], [], []
    qu, vu = _unit(q), _unit(v)
    step = max(1, 4_000_000 // max(1, len(v)))
    for i in range(0, len(q), step):
        near = qu[i:i + step] @ vu.T
        near[q_id[i:i + step, None] == ids[None, :]] = -np.inf
        if seen is not None:
            near[~seen(i, i + step)] = -np.inf
        kth = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
        rows, cols = np.nonzero((near >= kth[:, None] - 1e-9) & np.isfinite(near))
        s = cosine(q[i + rows], v[cols])
        order = np.lexsort((ids[cols], -s, rows))
        rows, cols, s = rows[order], cols[order], s[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        ok = rank < k
        out_q.append(q_id[i + rows[ok]])
        out_row.append(cols[ok])
        out_s.append(s[ok])
    return np.concatenate(out_q), np.concatenate(out_row), np.concatenate(out_s)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter(
        F.col("vec_id").isNotNull() & usable())


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with one and the same vector those of the k + 1 smallest ids, k rows of an id at
    most: no other can be among a query's k nearest, whichever of the ids is its own."""
    ids = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("n"))
    same = Window.partitionBy("embedding").orderBy("vec_id")
    first = ids.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    return first.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)))).alias("copy")).drop("copy")


def fit_tree(rows: DataFrame, n_rows: int, sample: int = SAMPLE) -> Tree | None:
    """Fitted in one task on the bounded sample; the driver gets the tree only."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [_matrix(b.column("embedding")) for b in batches if b.num_rows]
        tree = Tree(_unit(np.concatenate(x)), n_rows) if x else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)], pa.binary())], names=["tree"])

    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    one = picked.repartition(1).sortWithinPartitions(F.xxhash64("vec_id"), "vec_id")
    got = one.select("embedding").mapInArrow(fit, "tree binary").collect()
    return pickle.loads(bytes(got[0]["tree"])) if got else None


def _assigner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.assign(_unit(_matrix(b.column("embedding")))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(leaf, pa.int32())],
                                             names=["vec_id", "embedding", "leaf"])
    return run


def calibrate(tree: Tree, indexed: DataFrame, queries: DataFrame, k: int, recall: float, n_cal: int) -> int:
    """The fewest visits with which sampled queries reach ``recall`` of their exact neighbours."""
    got = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(n_cal).collect()
    if not got:
        return 1
    q_id = np.array([r["vec_id"] for r in got], np.int64)
    q = np.array([r["embedding"] for r in got], np.float64)
    shared = indexed.sparkSession.sparkContext.broadcast((q_id, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            own, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            for qi, row, s in zip(*_nearest(ids, x, own, _matrix(b.column("embedding")), k)):
                best.setdefault(int(qi), []).append((-s, int(own[row]), int(leaf[row])))
            best = {i: sorted(r)[:k] for i, r in best.items()}
        flat = [(i, -s, v, leaf) for i, r in best.items() for s, v, leaf in r]
        cols = list(zip(*flat)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.int64(), pa.float64(), pa.int64(), pa.int32()))], names=["query_id", "score", "vec_id", "leaf"])

    near = indexed.mapInArrow(run, "query_id long, score double, vec_id long, leaf int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()
    rank = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(u, len(tree.leaves)))}
            for i, u in zip(q_id, _unit(q))}
    needed = np.sort([rank[r["query_id"]][r["leaf"]] + 1 for r in true]) if true else np.array([1])
    for visits in np.unique(needed):                   # widen until the recall is reached
        if np.searchsorted(needed, visits, side="right") >= recall * len(needed):
            return int(visits)
    return len(tree.leaves)


def _visitor(shared, visits: int, bin_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(_matrix(b.column("embedding"))) if b.num_rows else []
            leaves = [shared.value.visit(q, visits) for q in u]
            bins = [np.unique(bin_of[x]) for x in leaves]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("embedding"), pa.array(leaves, pa.list_(pa.int32())),
                 pa.array(bins, pa.list_(pa.int32()))], names=["vec_id", "embedding", "leaves", "bins"])
    return run


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = RECALL, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows by cosine of each row for which
    ``is_query`` (over ``vec_id``) holds, one search for each dimension there is."""
    rows = _prepared(vectors, id_col, vector_col)
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for d in sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect()):
        found = _search(rows.filter(F.size("embedding") == d), is_query, k, recall, sample, calibration)
        out = out if found is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, is_query: Column, k: int, recall: float, sample: int, calibration: int) -> DataFrame | None:
    """The search among vectors of one dimension."""
    spark = rows.sparkSession
    base = materialize(_candidates(rows, k), "ann-rows")
    queries = materialize(rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    n = base.count()
    tree = fit_tree(base, n, sample)
    result = "query_id long, vec_id long, score double"
    if tree is None:
        return None
    shared = spark.sparkContext.broadcast(tree)
    element = base.schema["embedding"].dataType.simpleString()
    indexed = materialize(base.mapInArrow(_assigner(shared), f"vec_id long, embedding {element}, leaf int"), "ann-index")
    visits = calibrate(tree, indexed, queries, k, recall, calibration)
    counts = dict(indexed.groupBy("leaf").count().collect())             # a row per leaf
    bin_of, size = np.zeros(len(tree.leaves), np.int32), [0]
    for leaf in range(len(tree.leaves)):                                  # neighbours in the tree
        if size[-1] and size[-1] + counts.get(leaf, 0) > PART:
            size.append(0)
        bin_of[leaf] = len(size) - 1
        size[-1] += counts.get(leaf, 0)
    asked = queries.mapInArrow(_visitor(shared, visits, bin_of), f"vec_id long, embedding {element}, leaves array<int>, bins array<int>")
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "leaves",
                                     F.explode("bins").alias("bin")), "ann-visits")
    asks = dict(asked.groupBy("bin").count().collect())
    split = spark.createDataFrame(
        [(leaf, int(b), max(1, -(-size[b] // PART)), max(1, -(-asks.get(int(b), 0) // QUERY_PART)))
         for leaf, b in enumerate(bin_of)], "leaf int, bin int, rp int, qp int")
    bins = F.broadcast(split.drop("leaf").distinct().coalesce(1))         # both bounded by the leaves
    own = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(bins, "bin").select("bin", own("query_id", "qp").alias("q"), each("rp").alias("r"), "query_id", "query", "leaves")
    right = indexed.join(F.broadcast(split.coalesce(1)), "leaf").select(
        "bin", own("vec_id", "rp").alias("r"), each("qp").alias("q"), "vec_id", "embedding", "leaf")
    n_leaves = len(tree.leaves)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        visited = np.zeros((a.num_rows, n_leaves), bool)
        leaves = a.column("leaves").combine_chunks()
        visited[np.repeat(np.arange(a.num_rows), pa.compute.list_value_length(leaves).to_numpy()), leaves.flatten().to_numpy()] = True
        ids, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
        q, row, s = _nearest(a.column("query_id").to_numpy(), _matrix(a.column("query")), ids, _matrix(b.column("embedding")), k,
                             lambda i, j: visited[i:j][:, leaf])
        return pa.table([pa.array(q), pa.array(ids[row]), pa.array(s)], names=names)

    keys = ["bin", "q", "r"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
