"""Instruction-set edges."""
from pyspark.sql import functions as F

from wordloom.operators import chat as ch


def test_mcq_rules(spark):
    rows = [(1, " Q? ", "a", "b", "c", "d", 2, "  why "),
            (2, "Q2", "a", "", "c", "d", 0, None),          # empty option: dropped
            (3, "Q3", "a", "b", None, "d", 1, None),        # null option: dropped
            (4, "Q4", "a", "b", "c", "d", None, None),      # null cop: dropped
            (5, "Q5", "a", "b", "c", "d", -1, None),        # negative cop: rejected
            (6, "Q6", "a", "b", "c", "d", 3, "   ")]        # whitespace exp: trailing space
    df = spark.createDataFrame(rows, "row_id long, question string, opa string, opb string, "
                                     "opc string, opd string, cop int, exp string")
    out = {r.row_id: r for r in ch.mcq_to_chat(df).collect()}
    assert set(out) == {1, 6}
    assert out[1].user == "Q?\nA. a\nB. b\nC. c\nD. d"
    assert out[1].assistant == "The correct answer is C. c. why"
    assert out[6].assistant == "The correct answer is D. d. "


def test_qa_and_instr_rules(spark):
    qa = spark.createDataFrame([(1, " q ", " NO ", " long "), (2, "q", None, "l"), (3, "  ", "yes", "l"),
                                (4, "q", "yes", "  ")],
                               "row_id long, question string, final_decision string, long_answer string")
    out = {r.row_id: r for r in ch.qa_to_chat(qa).collect()}
    assert set(out) == {1, 2}
    assert out[1].user == "q" and out[1].assistant == "No. long"
    assert out[2].assistant == "l"
    ins = spark.createDataFrame([(1, " do ", " ctx ", " ok "), (2, "do", "", "ok"), (3, "do", None, " ")],
                                "row_id long, instruction string, input string, output string")
    out = {r.row_id: r for r in ch.instr_to_chat(ins).collect()}
    assert set(out) == {1, 2}
    assert out[1].user == "do\nctx" and out[2].user == "do"


def _examples(spark, pairs, max_len):
    df = spark.createDataFrame([("s", i, u, a) for i, (u, a) in enumerate(pairs)],
                               "source string, row_id long, user string, assistant string")
    return ch.truncate_examples(ch.chat_encode(df, None), max_len)


def test_truncation_and_short_drop(spark):
    # prompt = [user] + bytes("\n" + u) + [assistant]; response = bytes("\n" + a) + [eot]
    ex = {r.row_id: r for r in _examples(spark, [("x" * 10, "y"), ("", ""), ("abc", "de")], 8).collect()}
    long = ex[0]                       # prompt of 13 >= max_len: kept, nothing to learn
    assert len(long.full) == 8 and long.n_target == 0 and set(long.labels) == {-1}
    assert ex[1].full == [3, 15, 4, 15, 0] and ex[1].labels == [-1, -1, -1, 15, 0]
    assert len(ex[2].full) == 8 and ex[2].n_target == 2


def test_collate_shapes_and_masks(spark):
    pairs = [("a" * (i % 5), "b" * (i % 3)) for i in range(21)]
    ex = _examples(spark, pairs, 64)
    b = ch.collate(ch.epoch_batches(ex, 2, 4, seed=0)).collect()
    assert len(b) == 42
    by = {}
    for r in b:
        by.setdefault((r.epoch, r.batch_id), []).append(r)
    for rows in by.values():
        assert len(rows) <= 4
        widths = {len(r.x) for r in rows} | {len(r.y) for r in rows}
        assert len(widths) == 1
        for r in rows:
            assert r.n_masked == sum(1 for v in r.y if v == -1)
            if r.n_pad:
                assert r.x[-r.n_pad:] == [1] * r.n_pad and r.y[-r.n_pad:] == [-1] * r.n_pad
    assert len([k for k in by if k[0] == 0]) == 6      # ceil(21 / 4), last batch partial
    orders = [[r.row_id for r in sorted(b, key=lambda r: (r.batch_id, r.row)) if r.epoch == e]
              for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_completion_extraction(spark):
    df = spark.createDataFrame([([3, 9, 4], [3, 9, 4, 7, 8]), ([3], [3])], "prompt array<int>, out array<int>")
    got = [list(r.completion) for r in ch.completion(df, True).collect()]
    assert got == [[7, 8], []]
    assert [list(r.completion) for r in ch.completion(df, False).collect()] == [[3, 9, 4, 7, 8], [3]]
