import re

from wordloom.llm import secrets as S
from wordloom.llm.shared import shared_path

TEXTS = ['password = "abcd1234"', "PassWord:abcd123", "token: secret: abcdefgh", "api-key=12345678 apikey='ABCDEFGH=='",
         "AKIA" + "A" * 12, "xAKIA" + "B" * 30, "AKIA" + "A" * 11, "f" * 32, "F" * 40, "0" * 31, "é" * 5 + "secret=é12345678",
         "ſecret=12345678", "toKen=12345678", "x" + "a1" * 20 + "g" + "b2" * 16, None, "", "secret=" + "a" * 40,
         "Bearer abcdefghijklmnopqrst", "ftp://user:hunter2secret@host/x", "eyJhbGciOiJI.eyJzdWIiOiIx.abc"]


def plain(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if m.end() - m.start() >= n]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans():
    for t in TEXTS:
        assert S.plain_base(t) == plain(t), t


def test_report_and_increment(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, TEXTS[0], "clash"), (None, TEXTS[0], "c")],
                                 "doc_id long, text string, blob string")
    ledger = S.BlobLedger(spark, shared_path(spark, "t-ledger"), {"base-1": S.RULE_VERSIONS["base-1"]})
    rows = S.secret_report(docs, ledger).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = TEXTS[0] if r["doc_id"] in (99, None) else TEXTS[r["doc_id"]]
        assert r["base_sha256"] == S.plain_digest(t) and r["spans"] == plain(t)
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == (plain(t).count(",") + 1 if plain(t) else 0)
    scanned = ledger.entries().count()
    assert scanned == len({t or "" for t in TEXTS})          # each content once
    # a second version: only the new content is read; a new rule version reads all once
    more = docs.unionByName(spark.createDataFrame([(200, "passwd=new-secret-1", "c")], docs.schema))
    S.secret_report(more, ledger).count()
    assert ledger.entries().count() == scanned + 1
    both = S.BlobLedger(spark, ledger.path)
    rows = {r["doc_id"]: r for r in S.secret_report(more, both).collect()}
    assert both.entries().count() == 2 * (scanned + 1)
    S.secret_report(more, both).count()
    assert both.entries().count() == 2 * (scanned + 1)       # nothing is scanned twice
    assert "bearer" in rows[17]["spans"] and "url_password" in rows[18]["spans"] and "jwt" in rows[19]["spans"]
    assert rows[17]["base_sha256"] == S.plain_digest(TEXTS[17])


def test_unfinished_batch_is_ignored(spark):
    path = shared_path(spark, "t-broken")
    spark.createDataFrame([("x", "base-1", [])], S.LEDGER_SCHEMA).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch-000000")
    assert S.BlobLedger(spark, path).batches() == []


def test_odd_rows(spark, odd, odd_rows, empty):
    ledger = S.BlobLedger(spark, shared_path(spark, "t-odd"))
    rows = S.secret_report(odd, ledger).collect()
    assert len(rows) == len(odd_rows)
    assert S.secret_report(empty, S.BlobLedger(spark, shared_path(spark, "t-empty"))).count() == 0


def test_many_null_ids_meet_their_own_blobs(spark):
    """A thousand rows without id: each blob's text is read once, not once for each such row."""
    texts = [f"note {i} token = abcdefgh{i:04d}" for i in range(1000)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0])], "doc_id long, text string").repartition(4)
    ledger = S.BlobLedger(spark, shared_path(spark, "t-nulls"))
    rows = S.secret_report(docs, ledger).collect()
    assert sorted(r["spans"] for r in rows) == sorted(plain(t) for t in [*texts, texts[0]])
    assert ledger.entries().count() == 2 * 1000
    S.secret_report(docs, ledger).count()
    assert len(ledger.batches()) == 1                        # the second scan had nothing to read
