"""Batched exact merges equal one-at-a-time greedy; B8/B9 round trip."""
import random
import time

import pytest
from pyspark.sql import functions as F

from wordloom.functions.text import BYTE_OFFSET, FIRST_MERGE_ID
from wordloom.operators.bpe import MAX_VOCAB, BpeModel, PairTable, accept_prefix, encode_piece, learn_merges
from wordloom.operators.tokenizer import decode, encode


def learn_merges_sequential(counts: dict[bytes, int], vocab_size: int,
                            min_frequency: int = 2) -> BpeModel:
    """Plain one-merge-at-a-time greedy with the same tie rule; the expected
    result of ``learn_merges``."""
    words = {tuple(b + BYTE_OFFSET for b in k): v for k, v in counts.items()}
    merges: list[tuple[int, int]] = []
    while FIRST_MERGE_ID + len(merges) < vocab_size:
        pc: dict[tuple[int, int], int] = {}
        for w, n in words.items():
            for i in range(len(w) - 1):
                pc[(w[i], w[i + 1])] = pc.get((w[i], w[i + 1]), 0) + n
        cand = [(p, c) for p, c in pc.items() if c >= min_frequency]
        if not cand:
            break
        (a, b), _ = min(cand, key=lambda pc_: (-pc_[1], max(pc_[0]), pc_[0][0], pc_[0][1]))
        new = FIRST_MERGE_ID + len(merges)
        merges.append((a, b))
        nxt: dict[tuple[int, ...], int] = {}
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == a and w[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            t = tuple(out)
            nxt[t] = nxt.get(t, 0) + n
        words = nxt
    return BpeModel(merges)


def _corpus(rng):
    alpha = "abcd"
    out = {}
    for _ in range(rng.randint(3, 12)):
        w = "".join(rng.choice(alpha) for _ in range(rng.randint(2, 8)))
        out[w] = out.get(w, 0) + rng.randint(1, 4)
    return out


def test_accept_prefix_rules():
    assert accept_prefix([(1, 2, 9), (3, 4, 8), (2, 5, 7)], 10) == [(1, 2), (3, 4)]
    assert accept_prefix([(1, 1, 9), (3, 4, 8)], 10) == [(1, 1)]
    assert accept_prefix([(1, 2, 9), (3, 4, 8)], 1) == [(1, 2)]


def test_batched_equals_sequential(spark):
    rng = random.Random(7)
    for trial in range(12):
        counts = _corpus(rng)
        df = spark.createDataFrame([(k, v) for k, v in counts.items()], "piece string, n bigint")
        vocab = 261 + rng.randint(3, 25)
        # small tables are counted anew; rounds in all tasks, in one task, or both
        got = learn_merges(df, vocab, max_pairs=rng.choice([2, 6, 1000]), task_pieces=rng.choice([0, 4, 1000]))
        want = learn_merges_sequential({k.encode(): v for k, v in counts.items()}, vocab)
        assert got.merges == want.merges, (trial, counts)


def test_encode_piece_matches_rank_order():
    m = BpeModel([(5 + ord("a"), 5 + ord("a")), (261, 5 + ord("a"))])
    ranks = m.ranks()
    assert encode_piece(b"aaaa", m.merges, ranks) == [261, 261]
    assert encode_piece(b"aaa", m.merges, ranks) == [262]


def test_roundtrip_with_merges(spark):
    texts = ["aaaa ababab", "\n\nword  x ", "it's 12 cafés", "emoji \U0001F600 ok", "é a b\x1c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from wordloom.operators.tokenizer import piece_counts
    model = learn_merges(piece_counts(df), 300, min_frequency=1)
    assert model.merges
    enc = encode(df, model, ["doc_id"])
    dec = decode(enc, model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.text for r in dec] == texts
    # byte level (no merges) gives the same text, and the merged encoding is shorter
    enc0 = encode(df, None, ["doc_id"])
    assert [r.text for r in decode(enc0, None, ["doc_id"]).orderBy("doc_id").collect()] == texts
    n0 = enc0.select(F.sum(F.size("ids"))).first()[0]
    n1 = enc.select(F.sum(F.size("ids"))).first()[0]
    assert n1 < n0


def test_merged_encode_equals_python(spark):
    texts = ["the cat the hat the bat", "that theme thus"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from wordloom.operators.tokenizer import piece_counts
    model = learn_merges(piece_counts(df), 280, min_frequency=2)
    got = {r.doc_id: list(r.ids) for r in encode(df, model, ["doc_id"]).collect()}
    both = encode(df, model, ["doc_id", "text"], text=["text", "text"], out=["a", "b"]).collect()
    assert all(list(r.a) == got[r.doc_id] == list(r.b) and r.text == texts[r.doc_id] for r in both)
    import regex
    from wordloom.functions.text import PIECE_PATTERN
    ranks = model.ranks()
    for i, t in enumerate(texts):
        want = []
        for p in regex.findall(PIECE_PATTERN, t):
            want += encode_piece(p.encode(), model.merges, ranks)
        assert got[i] == want


def _rank_by_rank(piece, merges):
    syms = [b + BYTE_OFFSET for b in piece]
    for r, (a, b) in enumerate(merges):
        out, i = [], 0
        while i < len(syms):
            if syms[i:i + 2] == [a, b]:
                out.append(FIRST_MERGE_ID + r)
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out
    return syms


def test_heap_encoding_equals_merging_rank_by_rank():
    rng = random.Random(3)
    for _ in range(60):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))): 1 for _ in range(20)}
        m = learn_merges_sequential(words, 261 + 25, min_frequency=2)
        for _ in range(20):
            p = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60)))
            assert encode_piece(p, m.merges, m.ranks()) == _rank_by_rank(p, m.merges)


def test_long_piece_is_quick():
    """An unbroken run of 200,000 bytes: n log n steps, not n squared."""
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abcdef") for _ in range(30)): 2 for _ in range(200)}
    m = learn_merges_sequential(words, 261 + 60)
    t = time.process_time()
    ids = encode_piece(bytes(rng.choice(b"abcdef") for _ in range(200_000)), m.merges, m.ranks())
    assert len(ids) < 200_000 and time.process_time() - t < 5


def test_vocabulary_fits_16_bits(spark):
    df = spark.createDataFrame([("ab", 2)], "piece string, n bigint")
    with pytest.raises(ValueError):
        learn_merges(df, MAX_VOCAB + 1)


def test_pair_table_follows_changes():
    t = PairTable([(1, 2, 9, 3), (3, 4, 9, 1), (5, 6, 7, 7)], 100)
    assert t.top(2) == [(1, 2, 9, 3), (3, 4, 9, 1)]
    t.change([(1, 2, -9, -3), (5, 6, 4, 1), (7, 2, 20, 2)])
    assert t.top(9) == [(7, 2, 20, 2), (5, 6, 11, 8), (3, 4, 9, 1)] == t.top(9)


def test_pair_table_keeps_its_bound():
    """Pairs that a full table leaves out are never better than its bound."""
    t = PairTable([], 8)
    t.change([(i, i + 1, 10 + i, 1) for i in range(20)])
    assert t.bound >= 10 and all(c > t.bound for c, _ in t.counts.values()) and len(t.counts) <= 8
    assert t.top(1) == [(19, 20, 29, 1)]


def test_rounds_equal_sequential_on_text(spark):
    """Hundreds of merges over the pieces of whole documents."""
    from wordloom.operators.tokenizer import training_pieces
    from wordloom.sources import tables
    rows = training_pieces(tables.corpus(spark, "/root/testdata/sf0.001").filter("doc_id % 10 = 0")).collect()
    df = spark.createDataFrame(rows, "piece string, n bigint")
    stats: dict = {}
    want = learn_merges_sequential({r.piece.encode(): r.n for r in rows}, 261 + 300).merges
    assert learn_merges(df, 261 + 300, max_pairs=300, task_pieces=400, stats=stats).merges == want
    assert stats["counts"] > 1 and 0 < stats["one_task"] < stats["rounds"] < 200
    assert learn_merges(df, 261 + 300).merges == want


def test_null_and_empty_texts_encode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "doc_id long, text string")
    m = BpeModel([(5 + ord("a"), 5 + ord("b"))])
    assert {r.doc_id: list(r.ids) for r in encode(df, m, ["doc_id"]).collect()} == {1: [], 2: [], 3: [261]}


def test_dictionary_encodes_a_piece_once(spark):
    from wordloom.operators.tokenizer import PieceDictionary
    from wordloom.sources.files import scratch_path
    texts = ["the cat the hat", None, "", "that cat\n\n é", "the cat the hat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    m = BpeModel([(5 + ord("t"), 5 + ord("h")), (261, 5 + ord("e"))])
    d = PieceDictionary(spark, scratch_path(spark, "pieces"), m)
    assert d.extend(df) == len({"the", " cat", " the", " hat", "that", "\n", "\n\n", " é"} & {r.piece for r in d.rows().collect()}) > 0
    assert d.extend(df) == 0                                        # nothing is encoded twice
    assert PieceDictionary(spark, d.path.rsplit("/", 1)[0], m).extend(df) == 0
    more = df.unionByName(spark.createDataFrame([(9, "the newest")], df.schema))
    with pytest.raises(Exception, match="not in the dictionary"):
        d.encode(more, ["doc_id"]).collect()
    assert d.extend(more) == 1
    want = {r.doc_id: list(r.ids) for r in encode(more, m, ["doc_id"]).collect()}
    assert {r.doc_id: list(r.ids) for r in d.encode(more, ["doc_id"]).collect()} == want and len(want) == 6
    other = PieceDictionary(spark, d.path.rsplit("/", 1)[0], BpeModel([(5 + ord("a"), 5 + ord("t"))]))
    assert other.rows().count() == 0 and other.extend(df) > 0        # another tokenizer, another dictionary


def test_dictionary_looks_up_distinct_pieces(spark):
    """Chunks ask once for a piece, and a text is cut once; repeated and null keys, null and empty texts stay."""
    from wordloom.operators.tokenizer import PieceDictionary
    from wordloom.sources.files import scratch_path
    texts = ["the cat the hat the cat", None, "", "that cat\n\n é the the", "", "the"] * 5
    df = spark.createDataFrame([(None if i % 4 == 0 else i % 3, "a" if i % 2 else None, t) for i, t in enumerate(texts)],
                               "doc_id long, source string, text string").repartition(2)
    m = BpeModel([(5 + ord("t"), 5 + ord("h")), (261, 5 + ord("e"))])
    d = PieceDictionary(spark, scratch_path(spark, "pieces"), m)
    assert d.extend(df) > 0
    plan = d.encode(df, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "collect_list" not in plan      # no row a token goes through the join
    keys = ["source", "doc_id"]
    want = sorted(map(str, encode(df, m, keys).collect()))
    for size in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            c = d.number(df, keys)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert d.extend(c) == 0
        assert sorted(map(str, d.encode(c, keys).collect())) == sorted(map(str, d.encode(df, keys).collect())) == want
        asked = c.filter("__words is not null").select("__chunk", F.explode("__words").alias("piece"))
        assert asked.count() == asked.distinct().count() and c.select("__chunk").distinct().count() >= (15 if size == "2" else 1)
    fresh = PieceDictionary(spark, scratch_path(spark, "pieces"), m)
    assert fresh.extend(c) == d.rows().count()
    none = df.filter("false")
    assert fresh.encode(none, keys).collect() == [] and fresh.extend(none) == 0


def test_chunks_keep_documents_whole(monkeypatch):
    import pyarrow as pa
    from wordloom.operators import tokenizer as tk
    monkeypatch.setattr(tk, "CHUNK_PIECES", 4)
    lists = [["a", "b"], [], ["b"], ["c"] * 9, ["a", "c"], [], ["a"]]
    b = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["p"])
    parts = list(tk._chunks(b, "p"))
    assert len(parts) > 1 and [x for p in parts for x in p.column("p").to_pylist()] == lists
    for p in parts:
        at, words = tk._numbered(p.column("p"))
        first, *rest = words.to_pylist()
        assert rest == [None] * (len(p) - 1) and len(first) == len(set(first))
        assert [[first[i] for i in x] for x in at.to_pylist()] == p.column("p").to_pylist()
    assert list(tk._chunks(b.slice(0, 0), "p")) == []


def test_specials_are_audited_against_the_stored_table(spark):
    from wordloom.operators.tokenizer import declared_specials, special_audit
    chats = spark.createDataFrame([("user",), ("tool",), (None,), ("user",)], "role string")
    vocab = BpeModel().vocab_df(spark)
    got = {r.text: (r.id, r.resolved) for r in special_audit(vocab, declared_specials(chats)).collect()}
    assert got == {"<|user|>": (3, True), "<|tool|>": (None, False), "<|endoftext|>": (0, True), "<|pad|>": (1, True)}
    short = special_audit(vocab.filter("coalesce(text, '') <> '<|pad|>'"), declared_specials(chats))
    assert {r.text for r in short.filter("not resolved").collect()} == {"<|tool|>", "<|pad|>"}


def test_roundtrip_audit_sees_a_wrong_text(spark):
    """A tokenizer whose decoder lost a byte does not pass the audit."""
    from wordloom.operators import tokenizer as tk
    df = spark.createDataFrame([("a", "abc"), ("a", "xyz"), ("b", "é")], "source string, text string")
    good = {r.source: (r.docs, r.mismatched) for r in tk.roundtrip_audit(df, None).collect()}
    assert good == {"a": (2, 0), "b": (1, 0)}

    class Lossy(BpeModel):
        def token_bytes(self):
            return [b"" if t == b"x" else t for t in super().token_bytes()]

    bad = {r.source: r.mismatched for r in tk.roundtrip_audit(df, Lossy()).collect()}
    assert bad == {"a": 1, "b": 0}
