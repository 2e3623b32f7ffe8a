import random

from pyspark.sql import functions as F

from wordloom.llm import decontaminate as D
from wordloom.llm.shared import word_list

ITEMS = "item_id long, text string"


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = word_list(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if m else ():
            wins.setdefault(tuple(w[k:k + m]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for t in docs:
        w, hit, found = word_list(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found |= wins[tuple(w[k:k + m])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_random_texts(spark):
    """Few words, so windows overlap, repeat and end in one another; several shards too."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, say(r.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(3, 14)]
    items = [(i, t) for i, t in items if len(t.split()) not in (1, 2)] + [(50, "z y"), (51, "Q"), (52, None), (53, "a a a a a a a a a a a")]
    docs = [say(r.randrange(0, 200)) for _ in range(60)] + ["z Y x z, y", "q", "", None, "a " * 500]
    want = brute(docs, items)
    for shard_words in (D.SHARD_WORDS, 10):
        got = D.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                     spark.createDataFrame(items, ITEMS), ["doc_id"], shard_words=shard_words).collect()
        for x in got:
            n = sum(h["end"] - h["start"] for h in x["hits"])
            assert (x["n_words"], n, x["items"]) == want[x["doc_id"]], x["doc_id"]


def test_decontaminated_texts_are_clean(spark):
    r = random.Random(5)
    say = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    own = items[2][1].split()
    docs = [(1, say(100), 0), (2, say(100) + ". " + items[0][1] + "! " + say(100), 0), (3, items[1][1], 0),
            # cutting the middle passage joins two halves of another window
            (4, say(80) + " " + " ".join(own[:9]) + " " + items[3][1] + " " + " ".join(own[9:15]) + " " + say(80), 0), (None, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, ITEMS)
    out = {x["doc_id"]: x for x in D.decontaminate(df, bench).collect()}
    assert set(out) == {1, 2, 4, None} and out[1]["text"] == docs[0][1] and out[1]["n_chars"] == 0
    assert all(n == 0 for _, n, _ in brute([x["text"] for x in out.values()], items))
    assert out[2]["n_chars"] == len(out[2]["text"]) and len(word_list(out[2]["text"])) == 200


def test_shards_do_not_show_in_the_cut_texts(spark):
    """Coverage is that of all shards' items; a cut may join a window of any other shard."""
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    items = [(i, say(30)) for i in range(40)]
    text = [t for _, t in items]
    docs = [(1, " ".join([*text[:6], say(120)])), (2, " ".join([*text[6:12], say(400)])), (3, say(50))]
    for k in range(0, 40, 2):           # one item's words around another's
        own = text[k].split()
        docs.append((10 + k, " ".join([say(80), *own[:9], text[k + 1], *own[9:15], say(80)])))
        docs.append((11 + k, " ".join([say(80), *text[k + 1].split()[:9], text[k], *text[k + 1].split()[9:15], say(80)])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    one, many = ({x["doc_id"]: x["text"] for x in D.decontaminate(df, bench, shard_words=n).collect()}
                 for n in (D.SHARD_WORDS, 100))
    assert one == many and 1 not in one and set(one) == {i for i, _ in docs} - {1}
    assert all(n == 0 for _, n, _ in brute(many.values(), items))


def test_odd_rows(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(1, odd_rows[3][1][:300]), (1, "one two"), (None, "word word")], ITEMS)
    rows = D.contamination(odd, bench).collect()
    want = brute([r[1] for r in odd_rows], [(1, odd_rows[3][1][:300]), (1, "one two"), ("null", "word word")])
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in rows) == sorted((a, b, len(c)) for a, b, c in want)
    assert D.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert D.contamination(empty, bench).count() == 0 and D.decontaminate(empty, bench).count() == 0
    assert D.decontaminate(odd, bench).columns == odd.columns
    assert D.scan(odd, bench, ["doc_id", "size"]).filter(F.col("size") == "clash").count() == len(odd_rows)
