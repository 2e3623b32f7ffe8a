import duckdb
import pytest

import __spark_entry__ as entry
from wordloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_registry():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in Q.registry()}
    assert set(Q.registry()) | {"pipeline"} <= names and set(Q.oracle()) <= names


@pytest.mark.parametrize("name", sorted(Q.oracle()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.registry()[name](spark, SF).toPandas()
    want = c.sql(Q.oracle()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d[cols].fillna("-").itertuples(index=False, name=None))
            for d in (got, want)]
    assert rows[0] == rows[1]


def test_contract_columns(spark):
    cols = {n: dict(f(spark, SF).dtypes) for n, f in Q.registry().items() if n.split("_")[0] in ("op1", "op5", "op8", "op10")}
    assert cols["op1_toxicity"] == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert cols["op5_suffix_array"] == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert cols["op8_neighbours"] == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert cols["op10_secret_ledger"]["base_sha256"] == "string" and cols["op10_secret_ledger"]["n_hex"] == "bigint"
