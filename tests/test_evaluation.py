"""Scoring edges."""
import math

from pyspark.sql import functions as F

from wordloom.operators import evaluation as ev


def _scorer(spark, pairs, unigrams, n, vocab, lam=0.9):
    big = spark.createDataFrame(pairs, "v int, w int, c long")
    uni = spark.createDataFrame(unigrams, "w int, cw long")
    ctx = big.groupBy("v").agg(F.sum("c").alias("cv"))
    return ev.BigramScorer(big, uni, ctx, n, vocab, lam)


def test_bigram_probability_formula(spark):
    s = _scorer(spark, [(1, 2, 3), (1, 3, 1)], [(2, 3), (3, 1), (1, 4)], 8, 10)
    pairs = spark.createDataFrame([(1, 2), (1, 9), (7, 2)], "prev int, cur int")
    got = {(r.prev, r.cur): r.logp for r in s.score_pairs(pairs).collect()}
    assert math.isclose(got[(1, 2)], math.log(0.9 * 3 / 4 + 0.1 * 4 / 18))
    assert math.isclose(got[(1, 9)], math.log(0.1 * 1 / 18))
    assert math.isclose(got[(7, 2)], math.log(0.1 * 4 / 18))       # unseen context


def test_truncation_skips_cut_predecessor(spark):
    cands = spark.createDataFrame([("t", 1, "ab", 0, 0, "xyz")],
                                  "task string, row_id long, context string, gold int, idx int, option string")
    toks = ev.candidate_tokens(cands, None, 3).first()      # ids = "ab" + " xyz" -> 6 ids, keep last 3
    assert toks.cut == 3 and toks.n_opt == 4
    s = _scorer(spark, [], [], 10, 261)
    sc = ev.option_scores(ev.candidate_tokens(cands, None, 3), s).first()
    # scorable: positions 4 and 5 only (position 3's predecessor was cut); denominator stays 4
    assert math.isclose(sc.score, 2 * math.log(0.1 * 1 / 271) / 4)


def test_argmax_ties_lowest_index_and_empty_task(spark):
    scores = spark.createDataFrame([("mcq", 1, 0, -1.0), ("mcq", 1, 1, -0.5), ("mcq", 1, 2, -0.5),
                                    ("mcq", 1, 3, -2.0)], "task string, row_id long, idx int, score double")
    cands = spark.createDataFrame([("mcq", 1, 2)], "task string, row_id long, gold int")
    p = ev.predictions(scores, cands).first()
    assert p.pred == 1 and p.correct == 0
    empty = spark.createDataFrame([], "task string, row_id long, pred int, gold int, correct int")
    assert ev.accuracy(empty).count() == 0


def test_topk_keeps_ties_and_handles_small_k(spark):
    s = _scorer(spark, [(1, 2, 5), (1, 3, 3), (1, 4, 3), (1, 5, 1)], [(2, 5), (3, 3), (4, 3), (5, 1)], 12, 6)
    got = {r.cur: r.prob for r in ev.topk_distribution(s, 2, 1.0).collect()}
    assert set(got) == {2, 3, 4}                              # tie at the k-th is kept
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-5)
    # k above the observed successors reaches unseen tokens (vocab 6: ids 0..5);
    # ids 0 and 1 never occur and tie at the smallest score, so both are kept
    assert {r.cur for r in ev.topk_distribution(s, 5, 1.0).collect()} == {0, 1, 2, 3, 4, 5}
    assert len(ev.topk_distribution(s, 10, 0.0).collect()) == 6   # k > vocab; T=0 clamps


def test_topk_matches_brute_force(spark):
    import random
    rng = random.Random(5)
    pairs = {}
    for _ in range(60):
        v, w = rng.randrange(12), rng.randrange(12)
        pairs[(v, w)] = pairs.get((v, w), 0) + rng.randint(1, 3)
    uni = {}
    for (v, w), c in pairs.items():
        uni[w] = uni.get(w, 0) + c
    n, vocab, lam, k = sum(uni.values()), 15, 0.7, 3
    s = _scorer(spark, [(v, w, c) for (v, w), c in pairs.items()], list(uni.items()), n, vocab, lam)
    got = {}
    for r in ev.topk_distribution(s, k, 1.0).collect():
        got.setdefault(r.prev, set()).add(r.cur)
    cv = {}
    for (v, w), c in pairs.items():
        cv[v] = cv.get(v, 0) + c
    for v in cv:
        sc = {w: math.log(lam * pairs.get((v, w), 0) / cv[v] + (1 - lam) * (uni.get(w, 0) + 1) / (n + vocab))
              for w in range(vocab)}
        kth = sorted(sc.values(), reverse=True)[k - 1]
        want = {w for w, x in sc.items() if x >= kth - 1e-12}
        assert got[v] == want, v


def test_context_scorer_sees_the_whole_sequence(spark):
    """A model whose probability depends on more than the previous token, over several length
    buckets; padding and other rows of a batch change nothing."""
    import numpy as np

    def log_probs(ids):
        return [-float(sum(ids[:i]) % 7) for i in range(len(ids))]

    def make_predict():
        return lambda m: np.array([log_probs([int(x) for x in row]) for row in m])

    cands = spark.createDataFrame([("t", i, "abc" * n, 0, k, o) for i, n in enumerate((1, 9, 12, 30, 41)) for k, o in enumerate(("xy", "z", ""))],
                                  "task string, row_id long, context string, gold int, idx int, option string")
    for max_len in (150, 5):
        toks = ev.candidate_tokens(cands, None, max_len)
        got = {(r.row_id, r.idx): r.score for r in ev.context_scores(toks, make_predict, max_len, batch_size=2).collect()}
        assert len(got) == 15
        for r in toks.collect():
            kept = list(r.ids)[r.cut:]
            first = max(r.n_ctx, r.cut + 1) - r.cut
            want = sum(log_probs(kept)[first:]) / r.n_opt
            assert abs(got[(r.row_id, r.idx)] - want) < 1e-9


def test_suffix_model_equals_plain_counts(spark):
    """Longest-suffix probabilities next to counts over the flat text, blocks of 4 tokens cut anywhere."""
    import math
    import random
    r = random.Random(2)
    text = [r.choice("abcd").encode()[0] + 5 for _ in range(200)]
    rows = [("s", "train", i // 4, text[i:i + 4]) for i in range(0, 200, 4)] + [("s", "val", 0, [9, 9])]
    blocks = spark.createDataFrame(rows, "source string, split string, block_id long, toks array<int>")
    cands = spark.createDataFrame([("t", i, c, 0, k, o) for i, c in enumerate(("abca", "ddd", "zz", "a")) for k, o in enumerate(("bcd", "ab", "z"))],
                                  "task string, row_id long, context string, gold int, idx int, option string")

    def p(before, w):
        q = (text.count(w) + 1) / (len(text) + 261)
        for k in range(1, min(3, len(before)) + 1):
            ctx = before[-k:]
            at = [i for i in range(k, len(text)) if text[i - k:i] == ctx]
            q = (sum(text[i] == w for i in at) + q) / (len(at) + 1)
        return q

    for max_len in (64, 5):
        toks = ev.candidate_tokens(cands, None, max_len)
        model = ev.fit_suffix_model(ev.suffix_counts(blocks), toks, 261)
        got = {(r.row_id, r.idx): r.score for r in ev.context_scores(toks, lambda: model.log_probs, max_len).collect()}
        for t in toks.collect():
            kept, first = list(t.ids)[t.cut:], max(t.n_ctx, t.cut + 1) - t.cut
            want = sum(math.log(p(kept[:i], kept[i])) for i in range(first, len(kept))) / t.n_opt
            assert abs(got[(t.row_id, t.idx)] - want) < 1e-9

