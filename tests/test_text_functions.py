"""Scalar helpers against Python string semantics."""
import regex

from pyspark.sql import functions as F

from wordloom.functions.text import (PIECE_PATTERN, byte_ids, capitalize, is_blank, pieces,
                                     py_strip, truthy, word_count)

EDGE = ["aaaa", "ababab", "\n\nword", "  x ", "it's", "emoji \U0001F600!", "é combining",
        "nb sp", "sep\x1cx", "", "   ", "Hello  World\t\tagain\n", "12,345.67 'll 'RE",
        "tabs\t\t\tand  spaces   ", "　ideographic　"]


def _df(spark, vals):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")


def test_strip_capitalize_wordcount(spark):
    rows = _df(spark, EDGE).select(
        "i", py_strip("s").alias("st"), capitalize("s").alias("cap"), word_count("s").alias("wc"),
        truthy("s").alias("tr"), is_blank("s").alias("bl")).orderBy("i").collect()
    for r in rows:
        s = EDGE[r.i]
        assert r.st == s.strip(), repr(s)
        assert r.wc == len(s.split()), repr(s)
        assert r.tr == bool(s)
        assert r.bl == (not s.strip())
        if s and not s[0].isspace():
            assert r.cap == s.capitalize(), repr(s)


def test_pieces_lossless_and_match_pattern(spark):
    rows = _df(spark, EDGE).select("i", pieces(F.col("s")).alias("p")).orderBy("i").collect()
    for r in rows:
        s = EDGE[r.i]
        assert "".join(r.p) == s, repr(s)
        assert list(r.p) == regex.findall(PIECE_PATTERN, s), repr(s)


def test_byte_ids(spark):
    rows = _df(spark, EDGE).select("i", byte_ids(F.col("s")).alias("b")).orderBy("i").collect()
    for r in rows:
        assert list(r.b) == [5 + x for x in EDGE[r.i].encode("utf-8")]


def test_null_handling(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(truthy("s").alias("t"), is_blank("s").alias("b")).first()
    assert r.t is False and r.b is True
