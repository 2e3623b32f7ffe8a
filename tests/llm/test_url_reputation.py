from wordloom.llm import url_reputation as U


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


URLS = ["http://a.com/en/1", "https://Example.COM/en/x?q=/fr/", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net/fr",
        "http://x.net/fr/2#a", "x.com/en/", "", None, "http://notexample.com/en/", "http://a.com", "http://a.com?x=1", "://h/p",
        "http://u:p@b.net:80/es/", "http://b.org/en/\nline", "ftp://É.Com/fr/", "http://a://b/c", "http:///fr/"]


def test_host_path_rule(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS)],
                                  "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain(u)
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (best.text if best else None)
        assert got[i]["verdict"] in ("allow", "block")
        if best:
            assert got[i]["verdict"] == best.verdict


def test_shrinkage(spark):
    """One bad page of a host barely moves it; many do; unseen hosts follow their domain."""
    rows = [("good.org", 200, 2), ("bad.bad.org", 100, 99), ("new.bad.org", 0, 0), ("once.fine.org", 1, 1), ("fine.org", 300, 0)]
    rep = {r["host"]: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()}
    assert rep["bad.bad.org"]["lower"] > 0.5 > rep["good.org"]["lower"]
    assert rep["new.bad.org"]["rate"] > rep["once.fine.org"]["rate"] * 0.9
    assert all(0 < r["rate"] < 1 and r["lower"] < r["rate"] for r in rep.values())


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages).count() == 0
    twice = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert U.judge(twice).count() == 3


def test_suffix_and_domain(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("",), ("x.y.z.org",)], "host string")
    s = U.suffix_of(F.col("host"))
    got = [(r[0], r[1]) for r in df.select(s, U.domain_of(F.col("host"), s)).collect()]
    assert got == [("co.uk", "b.co.uk"), ("com", "b.com"), ("com", "com"), ("", ""), ("org", "z.org")]
