import random
import re

from wordloom.llm import surrogates as S

KEY = "test key"
TEXT = ("Mail Jo.Doe7@Mail8.example.com or jo.doe7@mail8.example.com, call +1 (988) 555-2485 / 988-555-2485, ip 42.144.35.254. "
        "Card 4111 1111 1111 1111; IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789. Mr. John Smith met Mrs. Anna Smith. "
        "Smith left, JOHN too. Госпожа Иванова. Version 1.2.3, 2024-01-02, 12:30, id 123456, key=a1b2c3d4e5f6a7b8c9d0.")


def test_detection():
    found = [(TEXT[s:e], k) for s, e, k, _ in S.detect(TEXT)]
    assert [k for _, k in found] == ["email", "email", "phone", "phone", "ipv4", "number", "iban", "ssn", "given", "family",
                                     "given", "family", "family", "given", "family"]
    assert S.detect("nothing 12 here") == [] and S.detect("a" * 100_000 + "1" * 100_000) == []


def test_format_type_and_coreference():
    new, found = S.replaced(TEXT, {}, KEY)
    again = S.detect(new)
    kinds = ("given", "family")
    assert [k for _, _, k, _ in again] == [k for _, _, k, _ in found]
    for (s, e, k, canon), (s2, e2, _, canon2) in zip(found, again):
        old, out = TEXT[s:e], new[s2:e2]
        assert old != out and old not in new
        if k not in kinds and k != "ipv4":
            assert len(old) == len(out)
            assert [c for c in old if not c.isalnum()] == [c for c in out if not c.isalnum()]
        if k in kinds:
            assert S.script_of(old) == S.script_of(out) and old.isupper() == out.isupper()
    canon = {}
    for (_, _, k, a), (_, _, _, b) in zip(found, again):
        assert canon.setdefault((k, a.split(":")[-1]), b.split(":")[-1]) == b.split(":")[-1]        # one entity, one surrogate
    card = next(c for _, _, k, c in again if k == "number")
    assert S.luhn_digit(card[:-1]) == card[-1] and card[0] == "4"
    assert S.iban_ok(next(c for _, _, k, c in again if k == "iban"))
    assert "+1 (" in new and new.endswith("Version 1.2.3, 2024-01-02, 12:30, id 123456, key=a1b2c3d4e5f6a7b8c9d0.")
    assert S.replaced(TEXT, {}, "other")[0] != new and S.replaced(TEXT, {}, KEY)[0] == new


def test_names_follow_gender():
    ends = {g: e for g, e in S.SYLLABLES["latin"][2].items()}
    for title, g in (("Mr.", "m"), ("Frau", "f")):
        new, _ = S.replaced(f"{title} Robin Miller came. Robin sat.", {}, KEY)
        given = new.split(" ")[1]
        assert given.endswith(ends[g]) and new.endswith(f"{given} sat.")


def test_letter_case_stays():
    for old in ("John.Doe@Example.COM", "JO@X.ORG", "jo@x.org", "aB9@Sub.Dom.net"):
        new, _ = S.replaced(f"to {old}.", {}, KEY)
        new = new[3:-1]
        assert [c.isupper() for c in new] == [c.isupper() for c in old] and new.lower() != old.lower()


def test_collisions_are_redrawn(spark):
    """One-letter addresses collide and hit one another; every surrogate ends up its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    ents = [("email", f"{c}@x.com") for c in letters] + [("ssn", "000000000")]
    out = S.attempts(spark.createDataFrame(ents, "kind string, canon string"), KEY).collect()
    new = [r["new"] for r in out]
    assert len(out) == len(ents) and len(set(new)) == len(new) and not set(new) & {c for _, c in ents}
    assert any(r["attempt"] > 0 for r in out)
    docs = spark.createDataFrame([(i, f"to {c} end") for i, (_, c) in enumerate(ents[:26])], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in S.anonymize(docs, KEY).collect()}
    want = {r["canon"]: r["new"] for r in out}
    assert texts == {i: f"to {want[c]} end" for i, (_, c) in enumerate(ents[:26])}


def test_full_spaces_end(spark):
    """Every number of a length is taken: surrogates grow instead of being drawn for ever."""
    ents = [("phone", str(i)) for i in range(10)] + [("ssn", f"{i:02d}") for i in range(100)]
    out = S.attempts(spark.createDataFrame(ents, "kind string, canon string"), KEY).collect()
    new = [(r["kind"], r["new"]) for r in out]
    assert len(set(new)) == len(ents) and not set(new) & set(ents)
    assert S.render("555-0199", "phone", "5550199", "23456789") == "234-56789"


def aligned(text, new):
    """``(kind, entity, surrogate)`` of each mention; surrogates here end at a space, and all between
    the mentions stays as it was."""
    out, at, before = [], 0, 0
    for s, e, kind, mention in S.detect(text):
        assert new.startswith(text[before:s], at)
        at += s - before
        got = re.compile(r"\S+").match(new, at)[0]
        out.append((kind, S.entity(kind, mention)[0], got.lower()))
        at, before = at + len(got), e
    assert new[at:] == text[before:]
    return out


def test_distinct_and_coreferent_over_a_corpus(spark):
    """Brute force over random corpora: an entity has one surrogate wherever and under whatever
    title it stands, two entities never share one, and no surrogate is an entity."""
    r = random.Random(11)
    first, last = ["Alex", "Robin", "Anna", "Paul", "Mia"], ["Brown", "Smith", "Alex", "Иванов"]
    titles = ["Mr.", "Mrs.", "Dr.", "Herr", "Frau", "Prof."]
    domains = [f"{c}.com" for c in "abcdef"]                           # one-letter domains collide
    say = [lambda: f"{r.choice(titles)} {r.choice(first)} {r.choice(last)} came", lambda: f"mail {r.choice('xyzw')}@{r.choice(domains)} now",
           lambda: f"call 988-555-{r.randrange(1000, 1020)} today", lambda: f"SSN 123-45-{r.randrange(6700, 6720)} ok", lambda: "nothing here"]
    docs = [(i, ". ".join(r.choice(say)() for _ in range(r.randrange(1, 6))) + ".") for i in range(60)]
    rows = {x["doc_id"]: x["text"] for x in S.anonymize(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), KEY).collect()}
    one: dict = {}
    for i, text in docs:
        for kind, canon, got in aligned(text, rows[i]):
            assert one.setdefault((kind, canon), got) == got, (kind, canon, text)
    names = {v for (k, _), v in one.items() if k in S.NAMES}
    assert len(names) == sum(k in S.NAMES for k, _ in one)              # given and family names share one space
    for kind in ("email", "phone", "ssn"):
        mine = {c: v for (k, c), v in one.items() if k == kind}
        assert len(set(mine.values())) == len(mine) and not set(mine) & {v.replace("-", "") for v in mine.values()}
    hosts = {c.split("@")[1]: v.split("@")[1] for (k, c), v in one.items() if k == "email"}
    assert len(set(hosts.values())) == len(hosts)
    assert not any(w in {x.lower() for x in first + last} for w in names)


def test_odd_rows(spark, odd, odd_rows, empty):
    more = spark.createDataFrame([(20, TEXT, "en", "s", len(TEXT), *["clash"] * 14)] * 2, odd.schema)
    rows = S.anonymize(odd.unionByName(more), KEY).collect()
    assert len(rows) == len(odd_rows) + 2
    texts = sorted((r["text"] or "" for r in rows if r["doc_id"] != 20))
    assert texts == sorted(r[1] or "" for r in odd_rows)              # clean rows stay
    own = [r for r in rows if r["doc_id"] == 20]
    assert own[0] == own[1] and own[0]["n_chars"] == len(own[0]["text"]) and own[0]["n_entities"] == 15
    assert not re.search("John|Smith|Иванова|4111|988", own[0]["text"])
    assert S.anonymize(empty, KEY).count() == 0 and S.anonymize(odd, KEY, report=False).columns == odd.columns
