import random

from wordloom.llm import similarity as S
from wordloom.llm.components import components
from wordloom.llm.shared import word_list


def brute(texts, threshold=0.8):
    """``(class id, links, copies)`` per row by comparing all sets."""
    sets = []
    for i, t in texts:
        w = word_list(t)
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    nodes = {}
    for (i, _), z in zip(texts, sets):
        nodes.setdefault(z, []).append(i)
    keys = [z for z in nodes if z]
    links = {z: [y for y in keys if y != z and len(y & z) / len(y | z) >= threshold] for z in keys}
    cls, seen = {}, set()
    for z in keys:
        if z in seen:
            continue
        todo, comp = [z], {z}
        while todo:
            for y in links[todo.pop()]:
                if y not in comp:
                    comp.add(y)
                    todo.append(y)
        seen |= comp
        ids = [i for y in comp for i in nodes[y] if i is not None]
        for y in comp:
            cls[y] = min(ids, default=None)
    return [(i, cls[z] if z else i, len(links[z]) if z else 0, len(nodes[z]) if z else 1) for (i, _), z in zip(texts, sets)]


def key(rows):
    return sorted(rows, key=str)


def got(df):
    return key([(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in df.collect()])


def test_against_all_pairs(spark):
    """Groups of near copies around the threshold, a passage all share, and exact copies."""
    r = random.Random(9)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, rows = say(40), []
    for _ in range(60):
        base = say(r.randrange(60, 200))
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = "edit"
            rows.append(" ".join(w + (passage if r.random() < 0.3 else [])))
    rows += ["a b c", "a b c", "A, b: c!", "a b", "", None] + [rows[0]] * 5
    texts = list(enumerate(rows))
    assert got(S.join(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))) == key(brute(texts))


def test_large_dense_group(spark, monkeypatch):
    """More near copies than a subproblem or a block holds."""
    monkeypatch.setattr(S, "SMALL", 20)
    monkeypatch.setattr(S, "BLOCK", 50)
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        w = list(base)
        w[r.randrange(150)] = f"edit{i}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(f"x{i}-{k}" for k in range(30))) for i in range(40)]
    assert got(S.join(spark.createDataFrame(texts, "doc_id long, text string"))) == key(brute(texts))


def test_odd_rows(spark, odd, odd_rows, empty):
    texts = [(r[0], r[1]) for r in odd_rows]
    assert got(S.join(odd)) == key(brute(texts))
    assert S.join(empty).count() == 0 and S.deduplicate(empty).count() == 0
    kept = S.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert [i for n, i in ids if not n] == [1, 3, 5, 6, 7, 8, 10, 11, 12, 13] and sum(n for n, _ in ids) == 1


def test_classes_apart_from_ids(spark):
    """A class is its texts: one id may stand in several, and a class may be without any."""
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    text = [say(60) for _ in range(8)]
    near = text[6].split()
    near[30] = "edit"
    rows = [(0, t) for t in text[:4]] + [(0, text[0].upper()), (0, text[1])] + [(None, text[4])] * 3 + [(None, text[5]), (0, "..."), (None, None)]
    rows += [(None, text[6])] * 2 + [(None, " ".join(near)), (3, text[7]), (2, text[7] + "!"), (None, text[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(S.join(df)) == key(brute(rows))
    joined = S.join(df).collect()
    assert len({x["class_key"] for x in joined} - {None}) == 8 and sum(x["class_key"] is None for x in joined) == 2
    kept = [(x["doc_id"], x["text"]) for x in S.deduplicate(df).collect()]
    words = sorted(" ".join(w.decode() for w in word_list(t)).replace("edit", near[29]) for _, t in kept if word_list(t))
    assert len(words) == len(kept) - 2 == 8 and (2, text[7] + "!") in kept and {(0, "..."), (None, None)} <= set(kept)
    assert {t for t in text[1:6]} <= {t for _, t in kept}


def test_recall_bound():
    assert S.recall_at(3, S.RUNS) > S.RECALL and S.recall_at(6, 2 * S.RUNS) > S.RECALL


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    up = {}
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    import sys
    sys.setrecursionlimit(5000)
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    rows = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert rows == {a: find(a) for a in up}
