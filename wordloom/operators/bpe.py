"""Byte-level BPE: the learned model and its exact batched merge learner.

The merge table is bounded by the vocabulary size (``MAX_VOCAB`` ids), which is what makes it safe to hold on the driver and to ship
to tasks. Everything that grows with the corpus stays in DataFrames.
"""
from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BYTE_OFFSET, FIRST_MERGE_ID, SPECIAL_TOKENS
from ..session import stored

MAX_VOCAB = 1 << 16         # ids are stored as 16-bit numbers
MAX_PAIRS = 4096            # pairs a round may start from
TASK_RUNS = 200_000         # distinct runs of such pairs that one task merges on its own
COVER = 256                 # pairs the first round starts from
REBUILD = 16                # rounds after which the pieces are merged anew from the raw ones
LONG_PIECE = 256            # symbols from which a piece is merged by heap


@dataclass
class BpeModel:
    """Specials (ids 0..4), the 256 bytes (ids 5..260), then merges by rank."""
    merges: list[tuple[int, int]] = field(default_factory=list)

    @property
    def vocab_size(self) -> int:
        return FIRST_MERGE_ID + len(self.merges)

    def token_bytes(self) -> list[bytes]:
        out = [b""] * len(SPECIAL_TOKENS) + [bytes([b]) for b in range(256)]
        for left, right in self.merges:
            out.append(out[left] + out[right])
        return out

    def ranks(self) -> dict[tuple[int, int], int]:
        return {p: r for r, p in enumerate(self.merges)}

    # --- A7: persisted as two small tables ------------------------------------
    def vocab_df(self, spark: SparkSession) -> DataFrame:
        """``vocab(id, token_hex, special, text)``; ``text`` is the special's name."""
        rows = []
        for i, name in enumerate(SPECIAL_TOKENS):
            rows.append((i, "", True, name))
        for i, tb in enumerate(self.token_bytes()[len(SPECIAL_TOKENS):], start=BYTE_OFFSET):
            rows.append((i, tb.hex().upper(), False, None))
        schema = "id int, token_hex string, special boolean, text string"
        return spark.createDataFrame(rows, schema)

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r, a, b, FIRST_MERGE_ID + r) for r, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int")

    @staticmethod
    def from_merges_df(df: DataFrame) -> "BpeModel":
        rows = df.orderBy("rank").select("left_id", "right_id").collect()
        return BpeModel([(r.left_id, r.right_id) for r in rows])


def encode_piece(piece: bytes, merges: list[tuple[int, int]],
                 ranks: dict[tuple[int, int], int]) -> list[int]:
    """Encode one pre-tokenized piece."""
    return merge_symbols([b + BYTE_OFFSET for b in piece], merges, ranks)


def merge_symbols(syms: list[int], merges: list[tuple[int, int]], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Apply the merges in ``ranks``: the lowest-rank pair present merges first, its
    occurrences left to right, until none applies. Pairs wait in a heap and
    symbols are linked, so n symbols take n log n steps."""
    syms = list(syms)
    n = len(syms)
    if n < 2:
        return syms
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    if not heap:
        return syms
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if syms[i] < 0 or j >= n or (syms[i], syms[j]) != merges[r]:
            continue                                   # merged away meanwhile
        syms[i], syms[j] = FIRST_MERGE_ID + r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (x := ranks.get((syms[i], syms[k]))) is not None:
                heapq.heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := ranks.get((syms[h], syms[i]))) is not None:
            heapq.heappush(heap, (x, h))
    return [s for s in syms if s >= 0]


class MergeTable:
    """Merges of ranks ``first`` and up for many symbol lists at once, as one flat array and the ends
    of the lists in it."""

    def __init__(self, merges: list[tuple[int, int]], first: int = 0):
        self.merges, self.first = merges, first
        self.ranks = {p: r for r, p in enumerate(merges) if r >= first}
        keys = np.array([a << 16 | b for a, b in merges[first:]], np.int64)
        order = np.argsort(keys)
        self.none = len(merges)
        self.keys, self.rank = keys[order], (order + first).astype(np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none).astype(np.int32)

    def merge(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge_symbols`` of each list: a step merges the lowest-rank pair of every list that still
        has one, all its occurrences left to right. Long lists go through the heap."""
        size = np.diff(ends)
        if not len(self.keys) or len(flat) < 2:
            return flat, ends
        row = np.repeat(np.arange(len(size)), size)
        parts, rows = [], []
        for i in np.flatnonzero(size >= LONG_PIECE).tolist():
            got = merge_symbols(flat[ends[i]:ends[i + 1]].tolist(), self.merges, self.ranks)
            parts.append(np.array(got, np.int32))
            rows.append(np.full(len(got), i))
        short = size[row] < LONG_PIECE
        syms, row = flat[short].astype(np.int32), row[short]
        rank = np.full(len(syms), self.none, np.int32)
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside] = self._ranks(syms[inside], syms[inside + 1])
        while len(syms):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            width = np.diff(np.concatenate([starts, [len(syms)]]))
            open_ = np.repeat(best < self.none, width)
            if not open_.all():
                parts.append(syms[~open_])
                rows.append(row[~open_])
                syms, row, rank = syms[open_], row[open_], rank[open_]
                width, best = width[best < self.none], best[best < self.none]
                if not len(syms):
                    break
            hit = rank == np.repeat(best, width)
            twin = hit[1:] & hit[:-1]                        # a self-pair in a run: every other one
            if twin.any():
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
                hit &= (place - begin) % 2 == 0
            at = np.flatnonzero(hit)
            syms[at] = FIRST_MERGE_ID + rank[at]
            keep = np.ones(len(syms), bool)
            keep[at + 1] = False
            syms, row, rank = syms[keep], row[keep], rank[keep]
            at -= np.arange(len(at))                         # a symbol left each time before
            again = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            rank[again] = self.none
            again = again[again < len(syms) - 1]
            again = again[row[again] == row[again + 1]]
            rank[again] = self._ranks(syms[again], syms[again + 1])
        row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        flat = np.concatenate([*parts, np.zeros(0, np.int32)])[np.argsort(row, kind="stable")]
        return flat, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])

    def encode(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as strings or bytes, and the ends of each piece's ids."""
        raw = raw.cast(pa.large_binary())
        _, ends, data = raw.buffers()
        ends = np.frombuffer(ends, np.int64, len(raw) + raw.offset + 1)[raw.offset:]
        flat = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
        return self.merge(flat.astype(np.int32) + BYTE_OFFSET, ends - ends[0])


# --- B6: exact batched merge learning ------------------------------------------

def pair_counts(state: DataFrame) -> DataFrame:
    """Sum of piece counts over each adjacent symbol pair (overlaps counted),
    on ``(sym ARRAY<INT>, n)``. Partial aggregation combines map-side, so a
    hot pair is pre-summed in every task before the shuffle."""
    s = state.filter(F.size("sym") >= 2)
    z = F.arrays_zip(F.slice("sym", 1, F.size("sym") - 1).alias("l"),
                     F.slice("sym", 2, F.size("sym") - 1).alias("r"))
    return (s.select(F.explode(z).alias("p"), "n")
            .groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r"))
            .agg(F.sum("n").alias("c")))


def order_pairs(pairs: DataFrame) -> DataFrame:
    """Merge priority: count desc, then max(left, right), left, right ascending."""
    return pairs.orderBy(F.desc("c"), F.greatest("l", "r"), "l", "r")


def accept_prefix(top: list[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """Longest prefix of symbol-disjoint pairs; a self-pair closes the batch."""
    used: set[int] = set()
    batch: list[tuple[int, int]] = []
    for left, right, _ in top:
        if len(batch) >= room or left in used or right in used:
            break
        batch.append((left, right))
        used.update((left, right))
        if left == right:
            break
    return batch


Entry = tuple[int, int, int, int]       # merge order: -count, larger symbol, left, right


def _entry(pair: tuple[int, int], c: int) -> Entry:
    return -c, max(pair), *pair


class PairTable:
    """Adjacent symbol pairs with their counts, kept up by signed changes, in merge order.

    A pair has its weighted count and its occurrences (each distinct piece once), which bound
    the pieces that hold it. The table has at most ``limit`` pairs; pairs left out have counts
    of ``bound`` at most. That stays true while merges are applied: a pair of old symbols only
    ever loses occurrences, and the pairs of a new symbol come in with all of theirs. Pairs
    above the bound are therefore exact and in their right order; when they run out, the
    caller counts anew.
    """

    def __init__(self, rows: list[tuple[int, int, int, int]], limit: int, bound: int = 0):
        self.limit, self.bound = limit, bound
        self.counts = {(left, right): (c, o) for left, right, c, o in rows if c > bound}
        self._heapify()

    def _heapify(self) -> None:
        self.heap = [_entry(p, c) for p, (c, _) in self.counts.items()]
        heapq.heapify(self.heap)

    def change(self, deltas: list[tuple[int, int, int, int]]) -> None:
        for left, right, dc, do in deltas:
            c, o = self.counts.get((left, right), (0, 0))
            if c + dc > self.bound:
                self.counts[left, right] = c + dc, o + do
                heapq.heappush(self.heap, _entry((left, right), c + dc))
            else:
                self.counts.pop((left, right), None)
        if len(self.counts) > self.limit:                    # keep the better half
            order = sorted((c for c, _ in self.counts.values()), reverse=True)
            self.bound = order[self.limit // 2]
            self.counts = {p: x for p, x in self.counts.items() if x[0] > self.bound}
            self._heapify()

    def top(self, n: int) -> list[tuple[int, int, int, int]]:
        """The next ``n`` pairs in merge order, ``(left, right, count, occurrences)``; they stay in."""
        out, entries, seen = [], [], set()
        while self.heap and len(out) < n:
            e = heapq.heappop(self.heap)
            pair = e[2:]
            if self.counts.get(pair, (0,))[0] != -e[0] or pair in seen:
                continue                                     # changed since
            seen.add(pair)
            entries.append(e)
            out.append((*pair, *self.counts[pair]))
        for e in entries:
            heapq.heappush(self.heap, e)
        return out


def _merged(syms: list[int], new: int, left: int, right: int) -> list[int]:
    """One left-to-right pass for one pair."""
    out, i, n = [], 0, len(syms)
    while i < n:
        if syms[i] == left and i + 1 < n and syms[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


class PieceState:
    """The distinct pieces as symbol lists under the merges so far, ``(ids, n)``. Each state follows
    from the one before by the new merges; after some rounds it is made from the raw pieces
    again, so what is lost with an executor is never far from what is stored."""

    def __init__(self, raw: DataFrame, merges: list[tuple[int, int]], before: "PieceState | None" = None):
        self.raw, self.merges, self.before = raw, list(merges), before
        self.depth = before.depth + 1 if before else 0
        merged = before is not None
        table = MergeTable(self.merges, len(before.merges) if merged else 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat, ends = table.merge(*_lists(b.column("ids"))) if merged else table.encode(b.column("raw"))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, b.column("n")], names=["ids", "n"])

        source = before.rows if merged else raw
        self.rows = source.mapInArrow(run, "ids array<int>, n bigint").filter(F.size("ids") >= 2).persist()

    def after(self, batch: list[tuple[int, int]]) -> "PieceState":
        if self.depth + 1 < REBUILD:
            return PieceState(self.raw, self.merges + batch, self)
        self.forget()
        return PieceState(self.raw, self.merges + batch)

    def top(self, n: int, min_frequency: int) -> list[tuple[int, int, int]]:
        """The first ``n`` pairs in merge order with their counts, ``(left, right, count)``."""
        found = order_pairs(all_pairs(self).filter(F.col("c") >= min_frequency)).limit(n).collect()
        if self.before:
            self.before.forget()                             # this state is there now
            self.before = None
        return [(r["l"], r["r"], r["c"]) for r in found]

    def forget(self) -> None:
        self.rows.unpersist()


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as one flat array and the ends of the lists in it."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), ends - ends[0]


def _pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a batch, the key of the pair that begins at each place (-1 at the end of a
    piece) and the piece's count."""
    flat, ends = _lists(b.column("ids"))
    n = np.repeat(b.column("n").to_numpy(), np.diff(ends))
    key = np.full(len(flat), -1, np.int64)
    key[:-1] = flat[:-1].astype(np.int64) << 16 | flat[1:]
    key[ends[1:] - 1] = -1                                   # a piece here has two symbols or more
    return flat, key, n


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


SUM_AT = 4_000_000          # pair counts a task holds before it sums them


def all_pairs(state: PieceState) -> DataFrame:
    """``(l, r, c)``: all pairs of the pieces as merged so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            _, key, n = _pairs(b)
            held.append(_sum_by(key[key >= 0], n[key >= 0]))
            size += len(held[-1][0])
            if size > SUM_AT:
                held = [_sum_by(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > SUM_AT // 2:
                    yield _pair_batch(*held[0])
                    held, size = [], 0
        if held:
            yield _pair_batch(*_sum_by(*map(np.concatenate, zip(*held))))

    return state.rows.mapInArrow(run, "l int, r int, c bigint").groupBy("l", "r").agg(F.sum("c").alias("c"))


def _pair_batch(key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key >> 16, pa.int32()), pa.array(key & 0xFFFF, pa.int32()), pa.array(c, pa.int64())],
                                      names=["l", "r", "c"])


def covered_runs(state: PieceState, cover: list[tuple[int, int]], limit: int) -> DataFrame:
    """``(run, n)``: the longest stretches of a piece whose every adjacent pair is covered, 16 bits a
    symbol, as often as they stand in the pieces. A task that alone has more than ``limit``
    different ones says so by a null run and stops: they are too many for one task."""
    keys = np.sort(np.array([a << 16 | b for a, b in cover], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = defaultdict(int)
        for b in batches:
            flat, key, n = _pairs(b)
            inside = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            edge = np.diff(np.concatenate([[0], inside.astype(np.int8)]))          # a run's last pair is never the last place
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            raw = flat.astype("<u2").tobytes()
            for i, j, c in zip((2 * first).tolist(), (2 * last + 2).tolist(), n[first].tolist()):
                found[raw[i:j]] += c
            if len(found) > limit:
                found = {None: 0}
                break
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["run", "n"])

    return state.rows.mapInArrow(run, "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def greedy_here(rows: list[tuple[list[int], int]], first_new: int, room: int, outside: Entry) -> list[tuple[int, int]]:
    """One-at-a-time greedy over ``rows``, the runs of covered pairs: merges while the best pair
    comes before ``outside``, the best that any other pair can be. A pair of a new symbol
    either lies in the runs with all its occurrences, or spans a pair that is not covered and
    so comes after ``outside``."""
    counts, where = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, (syms, n) in enumerate(rows):
        for pair in zip(syms, syms[1:]):
            x = counts[pair]
            x[0] += n
            x[1] += 1
            where[pair].add(i)
    table = PairTable([(*p, c, o) for p, (c, o) in counts.items()], MAX_VOCAB * 64, -outside[0] - 1)
    merges: list[tuple[int, int]] = []
    while len(merges) < room and (top := table.top(1)) and _entry(top[0][:2], top[0][2]) < outside:
        left, right = pair = top[0][:2]
        new, changed = first_new + len(merges), defaultdict(lambda: [0, 0])
        for i in where.pop(pair):
            old, n = rows[i]
            now = _merged(old, new, left, right)
            if len(now) == len(old):
                continue                                     # merged away meanwhile
            rows[i] = now, n
            for sign, syms in ((-1, old), (1, now)):
                for p in zip(syms, syms[1:]):
                    x = changed[p]
                    x[0] += sign * n
                    x[1] += sign
                    if sign > 0 and new in p:
                        where[p].add(i)
        table.change([(*p, c, o) for p, (c, o) in changed.items() if c or o])
        merges.append(pair)
    return merges


def greedy_round(state: PieceState, cover: list[tuple[int, int]], room: int, outside: Entry,
                 limit: int) -> tuple[list[tuple[int, int]], int] | None:
    """``greedy_here`` in one task over the distinct runs of covered pairs: the merges, and how many
    runs there were; nothing, if they are more than ``limit``."""
    first_new = FIRST_MERGE_ID + len(state.merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[list[int], int]] = []
        merges, held = None, 0
        for b in batches:
            if b.column("run").null_count or len(rows) + len(b) > limit:
                break
            rows += [(np.frombuffer(x, "<u2").tolist(), n) for x, n in zip(b.column("run").to_pylist(), b.column("n").to_pylist())]
        else:
            held = len(rows)
            rows.sort()
            merges = greedy_here(rows, first_new, room, outside)
        out = [(-1, held, 0), *((i, *p) for i, p in enumerate(merges))] if merges is not None else []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (zip(*out) if out else ((),) * 3)], names=["rank", "l", "r"])

    found = covered_runs(state, cover, limit).coalesce(1).mapInArrow(run, "rank int, l int, r int").collect()
    if not found:
        return None
    (_, held, _), *rows = sorted(tuple(r) for r in found)
    return [x[1:] for x in rows], held


def learn_merges(piece_counts: DataFrame, vocab_size: int, min_frequency: int = 2, batch_limit: int = 64,
                 max_pairs: int = MAX_PAIRS, task_pieces: int = TASK_RUNS, max_rounds: int | None = None,
                 stats: dict | None = None) -> BpeModel:
    """Greedy BPE merges until ``vocab_size`` or no pair reaches ``min_frequency``.

    ``piece_counts`` is ``(piece STRING, n BIGINT)`` (B4). A round counts all pairs in all tasks and
    covers the first of them in merge order. All that one-at-a-time greedy does before a pair
    that is not covered comes first happens inside the runs of covered pairs, and the distinct
    runs are few: one task gets them with their counts and goes on greedily, for hundreds of
    merges. Then all tasks merge their pieces. If the runs are more than ``task_pieces``, the round
    takes the pairs that are first whatever the order instead, and the next one covers fewer;
    while they are less than half, the next one covers more, ``max_pairs`` at most. The driver
    holds the merges and the covered pairs. ``stats``, if given, gets the number of rounds, of
    those in one task and of whole counts.
    """
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"vocab_size {vocab_size} exceeds {MAX_VOCAB}")
    spark = piece_counts.sparkSession
    raw = F.encode(F.col("piece"), "UTF-8")
    pieces = stored(piece_counts.select(raw.alias("raw"), F.col("n").cast("bigint").alias("n")).filter(F.length("raw") >= 2), "pieces")
    pieces = pieces.repartition(2 * spark.sparkContext.defaultParallelism).persist()       # small but costly rows
    state, want = PieceState(pieces, []), min(COVER, max_pairs)
    count = {"rounds": 0, "one_task": 0, "counts": 0}
    while FIRST_MERGE_ID + len(state.merges) < vocab_size and (max_rounds is None or count["rounds"] < max_rounds):
        top = state.top(max(want, batch_limit) + 1, min_frequency)
        count["counts"] += 1
        if not top:
            break
        room = vocab_size - FIRST_MERGE_ID - len(state.merges)
        outside = _entry(top[want][:2], top[want][2]) if want < len(top) else (1 - min_frequency, 0, 0, 0)
        got = greedy_round(state, [x[:2] for x in top[:want]], room, outside, task_pieces) if task_pieces else None
        if got:
            batch, held = got
            count["one_task"] += 1
            want = want if held > task_pieces // 2 else min(2 * want, max_pairs)
        else:
            batch = accept_prefix(top[:batch_limit], room)
            want = max(want // 2, 1)
        state = state.after(batch)
        count["rounds"] += 1
    state.forget()
    pieces.unpersist()
    if stats is not None:
        stats.update(count)
    return BpeModel(state.merges)
