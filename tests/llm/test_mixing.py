from collections import defaultdict

from wordloom.llm import mixing
from tests.llm.conftest import SCHEMA, row


def water_fill(sizes, weights):
    """Targets by repeated resharing."""
    total, target, open_ = sum(sizes.values()), {}, dict(weights)
    left = float(total)
    while open_:
        unit = left / sum(open_.values())
        full = [s for s in open_ if unit * open_[s] > 3 * sizes[s] + 1e-9]
        if not full:
            target |= {s: unit * w for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_and_taken(spark):
    rows = [row(i, "w " * (1 + i * 7 % 13), source=f"s{i % 5}") for i in range(300)]
    rows += [row(1000 + i, "w " * 400, source="s0") for i in range(40)] + [row(5000, "w w w", source=None)]
    got = mixing.mixed_sizes(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = water_fill(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6
        assert abs(taken[s] - expected[s]) <= 1
    assert any(t == 3 * sizes[s] for s, t in target.items())     # a stopped source


def test_thresholds_are_nested(spark):
    """A larger budget keeps every document of a smaller one."""
    rows = [row(i, "w " * (1 + i % 9), source="ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = []
    for weights in ((1, 3), (1, 2), (2, 2)):                     # source a grows
        got = mixing.mixed_sizes(docs, weights=weights).collect()
        kept.append({r["doc_id"]: r["taken"] for r in got if r["doc_id"] % 2 == 0})
    for small, large in zip(kept, kept[1:]):
        assert all(large[i] >= n for i, n in small.items())


def test_odd_rows(odd, odd_rows, empty):
    out = mixing.mix(odd)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert all(r["size"] == len((r["text"] or "").split()) for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(t - g) <= 3 for t, g in by.values())
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(odd.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["text"]): r["taken"] for r in rows}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_sizes(empty).count() == 0
