import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_similarity import brute as classes
from wordloom.llm import mixing, surrogates, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against a plain version on its own input."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, bench = documents, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != "mix":
            assert docs.columns == documents.columns
        if name == "toxicity":
            net = toxicity.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
            score = {r["doc_id"]: r["score"] for r in toxicity.score(documents, net, ["doc_id"]).collect()}
            assert set(after) == {i for i in before if score[i] < toxicity.THRESHOLD}
        if name == "near_copies":
            want = {c for _, c, _, _ in classes([(i, r["text"]) for i, r in before.items()])}
            assert set(after) == want and all(after[i] == before[i] for i in after)
        if name == "decontamination":
            ids = list(before)
            found = dict(zip(ids, hits([before[i]["text"] for i in ids], bench)))
            assert set(after) == {i for i in ids if found[i][1] <= 0.5 * found[i][0]}
            assert all(after[i] == before[i] for i in after if not found[i][1])
            assert all(n == 0 for _, n, _ in hits([r["text"] for r in after.values()], bench))
        if name == "personal_data":
            assert set(after) == set(before)
            for i, r in after.items():
                own = surrogates.detect(before[i]["text"])
                assert (r["text"] == before[i]["text"]) == (not own) and r["n_chars"] == len(r["text"])
        if name == "mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(spark.createDataFrame(list(before.values()), documents.schema)).collect()}
            assert {i: r["taken"] for i, r in after.items()} == {i: n for i, n in taken.items() if n > 0}


def test_empty_table(spark, empty):
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_odd_rows_pass(spark, odd):
    docs = odd
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != "mix":
            assert docs.columns == odd.columns
    assert docs.count() > 0


def test_run_writes_each_stage(spark):
    assert P.run(spark, SF).count() > 0
