"""Ranked lexical search by presence-mask grouping.

Each item asks for its highest-scoring documents over its distinct terms. A pass over the
documents writes an index of the terms asked for: per document its length and the counts of
the asked terms it holds. Totals (documents, terms) and document frequencies are aggregates
of that index. The search reads the index in chunks of documents. In a chunk every term has
a bitmap of the documents that hold it; an item's bitmaps, put side by side, give each
document its mask of matched terms. Documents with one mask form a group, whose score is at
most the sum of each matched term's highest share in the chunk. Groups are evaluated by
descending bound until the bound falls below the item's k-th best score so far, which a task
carries from chunk to chunk. What cannot reach the k best is never scored; the result is
exact. A task hands on k rows an item, and two rounds of ranking merge them.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, so what is sent to the tasks is
bounded however many items there are; each block is one index and one search. One item's
distinct terms are held whole by a task.

Defined cases: null and empty texts have no terms and are never found; rows of one item_id
are one item with the terms of all its rows, a null item_id is an item too; an item without
terms, or whose terms no document holds, has no rows; equal scores go by ascending doc_id,
null ids last; repeated rows of a document are ranked one by one; empty tables give an empty
result; long texts are read whole; further columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hashed_words, materialize, row_slices, small_batches, text_bytes

TOP = 50
BLOCK_TERMS = 100_000      # (item, term) rows of one block
CELLS = 1 << 23            # terms x documents of a chunk
SLAB = 256                 # documents scored at a time, whole groups
SPREAD = 64                # first-round groups of an item's candidates
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"     # after A-Z are lower-cased (fixed value)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Block:
    """Items of one block: ids, the distinct terms of all of them, and each item's term rows."""

    def __init__(self, rows: list[tuple]):
        by_item: dict = {}
        for item, term in rows:
            by_item.setdefault(item, []).append(term.encode())
        self.items = list(by_item)
        words = sorted({t for ts in by_item.values() for t in ts})
        joined = b" ".join(words)
        _, _, _, h = hashed_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        order = np.argsort(h)
        self.hashes = h[order]
        place = {words[int(k)]: i for i, k in enumerate(order)}
        self.terms = [np.array(sorted(place[t] for t in ts), np.int64) for ts in by_item.values()]


def blocks_of(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[Block]:
    """Blocks of whole items, one at a time; an item's terms are distinct."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    terms = items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    terms = materialize(terms.distinct(), "search-terms")
    n = max(1, -(-terms.count() // block_terms))
    for k in range(n):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).toLocalIterator()
        block = Block([(r["item"], r["term"]) for r in rows])
        if block.items:
            yield block


def _indexer(block, id_type: pa.DataType):
    schema = pa.schema([("doc", id_type), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value.hashes
        v = len(asked)
        some = np.zeros(1 << 20, bool)
        some[asked & np.uint64((1 << 20) - 1)] = True
        for b in small_batches(batches, "text"):
            data, off = text_bytes(b.column("text"))
            for i, j in row_slices(off):
                rows, _, _, h = hashed_words(data, off[i:j + 1])
                n = np.bincount(rows, minlength=j - i)
                at = np.flatnonzero(some[h & np.uint64((1 << 20) - 1)])
                place = np.minimum(np.searchsorted(asked, h[at]), v - 1)
                hit = asked[place] == h[at]
                pairs, counts = np.unique(rows[at[hit]] * v + place[hit], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(j - i + 1) * v).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % v, counts)]
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(i, j - i), pa.array(n, pa.int64()), *lists], schema=schema)

    return run


def index(docs: DataFrame, block, id_col: str, text_col: str) -> DataFrame:
    """``(doc, n, terms, counts)`` of every document with a term; ``terms`` are rows of the block."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, n long, terms array<int>, counts array<int>"
    return materialize(rows.mapInArrow(_indexer(block, pa.int64()), schema).filter("n > 0"), "search-index")


def weights(postings: DataFrame, n_docs: int, n_terms: int) -> np.ndarray:
    """``floor(1000 ln((2N + 2) / (2 df + 1)))`` per term of the block; one row per term comes here."""
    df = np.zeros(n_terms, np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Best:
    """The k best (score, document) of one item, ties to the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must score to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least
        s, d, n = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((d, n, -s))[:self.k]
        self.score, self.doc, self.null = s[order], d[order], n[order]


def mask_groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks of the columns of ``present`` (terms x documents), as rows of bits, and each
    document's mask."""
    packed = np.packbits(present, axis=0).T
    wide = np.zeros((packed.shape[0], -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    key = wide.view(np.uint64)[:, 0] if wide.shape[1] == 8 else np.ascontiguousarray(wide).view(f"V{wide.shape[1]}")[:, 0]
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return present[:, first].T, group


def search_chunk(present: np.ndarray, share: np.ndarray, weight: np.ndarray, doc: np.ndarray, null: np.ndarray,
                 terms: np.ndarray, highest: np.ndarray, best: Best) -> int:
    """One item over one chunk; returns how many documents were scored."""
    w = weight[terms]
    if int((w * highest[terms]).sum()) < best.least:
        return 0
    masks, group = mask_groups(present[terms])
    bound = masks @ (w * highest[terms])
    order = np.argsort(-bound[group], kind="stable")
    limit = bound[group][order]
    done, n = 0, len(order)
    while done < n and limit[done] >= best.least:
        to = min(n, done + SLAB)
        to = int(np.searchsorted(-limit, -limit[to - 1], side="right"))          # whole groups
        for a in range(done, to, 8 * SLAB):
            at = order[a:min(to, a + 8 * SLAB)]
            best.add(w @ share[np.ix_(terms, at)].astype(np.int64), doc[at], null[at])
        done = to
    return done


def _searcher(block, weight: np.ndarray, n_docs: int, n_words: int, k: int):
    def chunks(batches: Iterator[pa.RecordBatch], v: int):
        size = max(64, CELLS // max(v, 1))
        for b in batches:
            for i in range(0, b.num_rows, size):
                yield b.slice(i, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        v = len(own.hashes)
        best = [Best(k) for _ in own.items]
        for b in chunks(batches, v):
            lists = b.column("terms")
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            t, tf = lists.flatten().to_numpy().astype(np.int64), b.column("counts").flatten().to_numpy().astype(np.int64)
            n = b.column("n").to_numpy()
            m = 50 + (50 * n * n_docs) // n_words
            present = np.zeros((v, b.num_rows), bool)
            present[t, at] = True
            share = np.zeros((v, b.num_rows), np.int32)        # at most 1,000,000
            share[t, at] = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
            highest = share.max(axis=1, initial=0).astype(np.int64)
            null = b.column("doc").is_null().to_numpy(zero_copy_only=False)
            doc = b.column("doc").fill_null(0).to_numpy()
            for terms, top in zip(own.terms, best):
                search_chunk(present, share, weight, doc, null, terms, highest, top)
        item = np.repeat(np.arange(len(best)), [len(x.score) for x in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.items[i] for i in item.tolist()], pa.int64()),
             pa.array(np.concatenate([x.doc for x in best]), pa.int64(), mask=np.concatenate([x.null for x in best])),
             pa.array(np.concatenate([x.score for x in best]), pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first in ``SPREAD`` parts of its candidates, then over those."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPREAD))).orderBy(*by)
    whole = Window.partitionBy("item_id").orderBy(*by)
    part = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents, scores above 0. Ids are
    integers."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for own in blocks_of(items.withColumn(item_col, F.col(item_col).cast("long")), item_col, text_col, block_terms):
        block = spark.sparkContext.broadcast(own)
        postings = index(docs, block, id_col, text_col)
        n_docs, n_words = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weight = weights(postings, n_docs, len(own.hashes))
        found = found.unionByName(postings.mapInArrow(_searcher(block, weight, n_docs, n_words, k),
                                                      "item_id long, doc_id long, score long"))
    return _ranked(found, k)
