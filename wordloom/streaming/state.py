"""Keyed state of the streams: what each key remembers between triggers."""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _order(doc_id, tie: int) -> tuple:
    """Null ids first, then by id, then by the text's hash: the batch order."""
    return (0, 0, tie) if doc_id is None or doc_id != doc_id else (1, int(doc_id), tie)


def smallest_of_each(keys: Sequence[str], n: int) -> Callable:
    """The ``n`` smallest documents of each key among a task's rows: the smallest of all are
    among them, so nothing is lost before the shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in frames:
            f = f if kept is None else pd.concat([kept, f], ignore_index=True)
            f = f.sort_values([*keys, "doc_id", "tie"], na_position="first", kind="stable")
            kept = f.groupby(list(keys), sort=False).head(n)
        if kept is not None:
            yield kept

    return run


class SmallestDocs(StatefulProcessor):
    """The ``n`` smallest documents of a source so far, with their texts (n texts a source, in
    RocksDB). Rows that agree in id and text are documents of their own."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "has_id int, doc_id bigint, tie bigint, copy int", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(k) for k in self.kept.keys()]
        copies: dict[tuple, int] = {}
        for k in held:
            copies[k[:3]] = max(copies.get(k[:3], 0), k[3] + 1)
        new: dict[tuple, str] = {}
        for f in rows:
            for doc_id, tie, text in zip(f["doc_id"].tolist(), f["tie"].tolist(), f["text"].tolist()):
                k = _order(doc_id, tie)
                copies[k] = copies.get(k, 0) + 1
                new[*k, copies[k] - 1] = text
            if len(new) > 4 * self.n:
                new = {k: new[k] for k in heapq.nsmallest(self.n, new)}
        first = set(heapq.nsmallest(self.n, [*held, *new]))
        out = []
        for k in held:
            if k not in first:
                out.append((self.kept.getValue(k)[0], -1))
                self.kept.removeKey(k)
        for k in first.intersection(new):
            out.append((new[k], 1))
            self.kept.updateValue(k, (new[k],))
        yield pd.DataFrame(out, columns=["text", "sign"])

    def close(self) -> None:
        pass


class LastWinsBest(StatefulProcessor):
    """The last logged value of each step of a run, and the best of them (one entry a step)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step bigint", "seq bigint, val double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = {k[0]: (v[0], v[1]) for k, v in self.steps.iterator()}
        changed = set()
        for f in rows:
            for step, seq, val in zip(f["step"].tolist(), f["ingest_seq"].tolist(), f["val_avg"].tolist()):
                if step not in steps or seq >= steps[step][0]:
                    steps[step] = seq, None if val is None or val != val else val
                    changed.add(step)
        for step in changed:
            self.steps.updateValue((step,), steps[step])
        known = [v for _, v in steps.values() if v is not None]
        yield pd.DataFrame({"run": [key[0]], "best_val": [min(known) if known else None], "steps": [len(steps)]})

    def close(self) -> None:
        pass
