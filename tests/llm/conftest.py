import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, score string, taken string, "
          "n_words string, hits string, items string, target string, blob string, node string, root string, doc string, "
          "tie string, n_entities string, n_links string")
WORDS = ["ab", "cde", "fghi", "Überall", "niño", "x9", "Lorem", "ipsum", "dolor", "sit", "amet", "token", "the", "of"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["clash"] * 14)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, repeated rows and a null source and id."""
    a, b = prose(1, 120), prose(2, 300)
    words = b.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    return [row(1, a), row(2, a), row(2, a), row(3, b), row(4, near), row(5, None), row(6, ""), row(7, "   \n\t"),
            row(8, "one two"), row(9, "one two"), row(10, prose(3, 40_000), source="t"), row(None, a, None, None),
            row(None, "no id here", None, None), row(11, "word " * 400, source=None), row(12, "x" * 2000),
            row(13, b + " " + a, source="t")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
