"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01), plus the entry smoke check."""
import pytest

from __spark_entry__ import entry
from wordloom.plans.catalog import registry
from wordloom.plans.oracle import oracle
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


#: Under the learned vocabulary of 8,000 ids; see test_learned.
LEARNED = {"a7_tokenizer_tables", "b6_learn_merges", "b7_vocab", "b8_encode_dictionary", "b8_encode_merged", "c3_head_split_merged", "e7_chat_encode_merged"}


def test_every_query_has_an_oracle():
    assert set(registry()) - set(oracle()) == LEARNED


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["ok"], r


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"source", "split", "segments", "tokens"}
    total = [r for r in rows if r.source is None and r.split is None][0]
    assert total.tokens == sum(r.tokens for r in rows if r.source is not None and r.split is not None)
