"""PII: keyed surrogates that keep type, gender, script and format.

Detected entities (e-mail, phone, IPv4, card or account number, social-security number, IBAN,
titled person names) are replaced by surrogates drawn from HMAC-SHA256 under a key: the same
entity gets the same surrogate wherever it stands and however it is written (coreference), and
punctuation, length, letter case, check digits, country codes and top-level domains stay as
they are. Names are mapped word by word, so "Mr. Smith" and "John Smith" stay one family; bare
mentions of a name that a title introduced in the document follow it. A name's gender is what
the titles of the whole corpus say ("Dr. Alex" is "Mr. Alex" elsewhere; both genders: neither),
so a name has one surrogate. Addresses of one domain keep one domain.

Distinctness is checked over the corpus: of entities that draw one surrogate, or a surrogate
that is itself an entity of the corpus, all but the smallest draw again with the next attempt
number until none is left. Given and family names share one space, domains have their own.
After ``RELAX`` attempts a surrogate grows by a character each time (octets of an IPv4 address
and the length of an IBAN cannot; their spaces are too large to fill), so this ends. Only what
differs from a text's own first draw is joined back, by the text's hash: texts meet a table
that is as small as the collisions are; Spark broadcasts it only if its written size allows.

The key is a parameter without default: whoever has it can try out short numbers.

Defined cases: null and empty texts stay; texts without entities stay byte for byte; rows with
equal texts get equal texts; null and repeated ids stay as rows; ``n_chars``, if there, follows
changed texts; columns named like an added one are replaced; an empty table gives an empty
result. Detection does not see names without a title anywhere in their document.
"""
from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator
from secrets import token_hex

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches, with_fields

KINDS = ("email", "iban", "ssn", "ipv4", "phone", "number", "given", "family")
NAMES = ("given", "family")
KEY_SETTING = "spark.wordloom.surrogateKey"
RELAX = 6                    # attempts before a surrogate may grow by a character

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)", re.ASCII)
NUMBER = re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?!\w)", re.ASCII)
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
                   r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)", re.ASCII)
_DIGITS = re.compile(r"\d[\d ().-]{5,}\d", re.ASCII)

# Titles and the gender they tell (fixed values).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Sr": "m", "Señor": "m", "Господин": "m",
          "Κύριος": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Mlle": "f", "Madame": "f",
          "Sra": "f", "Srta": "f", "Señora": "f", "Госпожа": "f", "Κυρία": "f", "Dr": "u", "Prof": "u"}
_UP, _LOW = r"A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ", r"a-zß-öø-ÿά-ώа-яё"
_NAME = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*|[{_UP}]{{2,}}"
PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ]((?:{_NAME})(?:[ ](?:{_NAME})){{0,2}})(?!\w)")

# Syllables and endings by script (fixed values): start, middle, end by gender.
SYLLABLES = {
    "latin": (("Al", "Ber", "Cor", "Da", "El", "Fen", "Gor", "Ha", "Il", "Jo", "Ka", "Lor", "Mi", "Nor", "Or", "Per", "Ro", "Sil", "Tor", "Vi"),
              ("ba", "de", "la", "li", "me", "na", "ne", "ra", "ri", "se", "ta", "ti", "va", "ve", "zo"),
              {"m": ("ton", "rik", "man", "dor", "nard"), "f": ("lina", "ria", "tessa", "mina", "rissa"), "u": ("len", "ry", "sel", "vis", "ren")}),
    "cyrillic": (("Ал", "Бо", "Ва", "Ге", "Да", "Ев", "Зо", "Ка", "Ле", "Ма", "Ни", "Ол", "Па", "Ро", "Се", "Та"),
                 ("ва", "ди", "ла", "ле", "ми", "на", "ра", "ри", "се", "то"),
                 {"m": ("слав", "мир", "дор", "нов", "лин"), "f": ("слава", "мира", "рина", "нова", "лина"), "u": ("ко", "ди", "ли", "ре", "ши")}),
    "greek": (("Αλ", "Βα", "Γε", "Δη", "Ελ", "Θε", "Κα", "Λε", "Μι", "Νι", "Πα", "Στε"),
              ("δα", "λε", "μα", "νι", "ρα", "σε", "τα", "φι"),
              {"m": ("ρος", "νος", "δης", "κος"), "f": ("να", "ρα", "λια", "δρα"), "u": ("λου", "νη", "ρη", "δη")}),
}


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_ok(compact: str) -> bool:
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Stream:
    """Keyed bytes of one entity and attempt."""

    def __init__(self, key: str, kind: str, canon: str, attempt: int):
        self.key, self.label, self.n, self.held = key.encode(), f"{kind}\0{canon}\0{attempt}\0".encode(), 0, 0
        self.left = 0

    def pick(self, n: int) -> int:
        if self.left < 16:
            block = hmac.new(self.key, self.label + str(self.n).encode(), hashlib.sha256).digest()
            self.n, self.held, self.left = self.n + 1, int.from_bytes(block, "big"), 32
        self.held, r = divmod(self.held, n)
        self.left -= 1
        return r

    def like(self, text: str) -> str:
        """The same classes: digits, lower and upper letters; all else stays."""
        return "".join(str(self.pick(10)) if c.isdigit() else chr(97 + self.pick(26)) if "a" <= c <= "z" else
                       chr(65 + self.pick(26)) if "A" <= c <= "Z" else c for c in text)


def surrogate(kind: str, canon: str, attempt: int, key: str, gender: str = "u", host: str | None = None) -> str:
    """The canonical surrogate of a canonical entity; ``host`` is the surrogate of an address's
    domain, its first draw if not given."""
    s = Stream(key, kind, canon, attempt)
    more = max(0, attempt - RELAX)
    letters = lambda n: "".join(chr(97 + s.pick(26)) for _ in range(n))
    digits = lambda n: "".join(str(s.pick(10)) for _ in range(n))
    if kind == "domain":
        names, top = canon.rsplit(".", 1)
        return s.like(names) + letters(more) + "." + top
    if kind == "email":
        local, domain = canon.split("@")
        return s.like(local) + letters(more) + "@" + (host or surrogate("domain", domain, 0, key))
    if kind == "ipv4":
        return ".".join(str(1 + s.pick(254)) for _ in range(4))
    if kind == "iban":
        body = s.like(canon[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}" if iban_ok(canon) else canon[:2] + s.like(canon[2:4]) + body
    if kind == "number":
        if luhn_digit(canon[:-1]) == canon[-1]:
            body = canon[0] + s.like(canon[1:-1]) + digits(more)
            return body + luhn_digit(body)
        return canon[0] + s.like(canon[1:]) + digits(more)
    if kind == "phone":
        return str(2 + s.pick(8)) + s.like(canon[1:]) + digits(more)
    if kind == "ssn":
        return s.like(canon) + digits(more)
    script, word = canon.split(":", 1)
    start, middle, end = SYLLABLES[script]
    ends = end[gender]
    size = 1 + min(2, len(word) // 5) + more
    return start[s.pick(len(start))] + "".join(middle[s.pick(len(middle))] for _ in range(size)) + ends[s.pick(len(ends))]


def entity(kind: str, canon: str) -> tuple[str, str]:
    """The entity of a mention, and the gender its document tells."""
    if kind not in NAMES:
        return canon, ""
    gender, canon = canon.split(":", 1)
    return canon, gender


def national(digits: str) -> str:
    """Phone digits without the country code of North America."""
    return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits


def _shape(original: str, digits: str) -> str:
    """``digits`` in the places of the original's digits, further ones behind them."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in original) + "".join(it)


def _cased(original: str, new: str) -> str:
    """``new`` in the letter case of the original, place by place."""
    return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) + new[len(original):]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical)`` by start, without overlaps; earlier kinds win."""
    out: list[tuple[int, int, str, str]] = []
    if "@" in text:
        out += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text)]
        out += [(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])) for m in SSN.finditer(text)]
        out += [(m.start(), m.end(), "ipv4", m[0]) for m in IPV4.finditer(text)]
        for m in NUMBER.finditer(text):
            out.append((m.start(), m.end(), "number", re.sub(r"\D", "", m[0])))
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15:
                cc = re.match(r"\+(\d{1,3})[ .(-]", m[0])
                own = digits[len(cc[1]):] if cc else national(digits) if m[0][0] == "+" else digits
                if len(own) >= 6:
                    out.append((m.start(), m.end(), "phone", own))
    out += _names(text)
    kept: list[tuple[int, int, str, str]] = []
    for x in sorted(out, key=lambda x: KINDS.index(x[2])):
        i = bisect.bisect(kept, x)
        if (i == 0 or kept[i - 1][1] <= x[0]) and (i == len(kept) or kept[i][0] >= x[1]):
            kept.insert(i, x)
    return kept


def _names(text: str) -> list[tuple[int, int, str, str]]:
    if not any(t in text for t in TITLES):
        return []
    found, given, family = [], {}, {}
    for m in PERSON.finditer(text):
        gender, words, at = TITLES[m[1]], m[2].split(" "), m.start(2)
        for i, w in enumerate(words):
            part = family if i == len(words) - 1 else given
            if part.get(w.lower(), "u") == "u":
                part[w.lower()] = gender
            found.append((at, at + len(w)))
            at += len(w) + 1
    if not found:
        return []
    known = {**{w: "family" for w in family}, **{w: "given" for w in given}}
    out = []
    for m in re.finditer(rf"(?<!\w)(?:{_NAME})(?!\w)", text):       # titled and bare mentions
        w = m[0].lower()
        if w in known:
            kind = known[w]
            gender = given[w] if kind == "given" else "u" if script_of(w) == "latin" else family[w]
            out.append((m.start(), m.end(), kind, f"{gender}:{script_of(w)}:{w}"))
    return out


def render(original: str, kind: str, canon: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if kind in ("given", "family"):
        return new.upper() if original.isupper() else new
    if kind == "email":
        return "@".join(_cased(*x) for x in zip(original.split("@"), new.split("@")))
    if kind == "phone":
        digits = re.sub(r"\D", "", original)
        return _shape(original, digits[:len(digits) - len(canon)] + new)
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in original)
    if kind == "ipv4":
        return new
    return _shape(original, new)


def replaced(text: str, drawn: dict, key: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and its mentions. ``drawn`` has ``(attempt, gender, host)`` of the
    entities whose surrogate is not the text's own first draw."""
    found = detect(text)
    parts, at = [], 0
    for s, e, kind, mention in found:
        canon, gender = entity(kind, mention)
        attempt, gender, host = drawn.get((kind, canon), (0, gender, None))
        parts += [text[at:s], render(text[s:e], kind, canon, surrogate(kind, canon, attempt, key, gender, host))]
        at = e
    return "".join([*parts, text[at:]]) if found else text, found


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text"):
        out = []
        for h, text in zip(b.column("text_hash").to_pylist(), b.column("text")):
            text = text.as_py()
            if text:
                out += sorted({(h, kind, *entity(kind, mention)) for _, _, kind, mention in detect(text)})
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))],
                                         names=["text_hash", "kind", "canon", "gender"])


DRAWN = "kind string, canon string, gender string, host string, attempt int, new string"


def _drawer(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in ("kind", "canon", "attempt", "gender", "host")))
            new = [surrogate(k, c, a, key, g or "u", h) for k, c, a, g, h in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "new"])
    return run


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, gender, host, attempt, new)``: draws until every surrogate is one entity's and
    no entity itself."""
    space = F.when(F.col("kind").isin(*NAMES), F.lit("name")).otherwise(F.col("kind")).alias("space")
    named = F.col("kind").isin(*NAMES)

    def draw(df: DataFrame) -> DataFrame:
        return materialize(df.select("kind", "canon", "gender", "host", "attempt").mapInArrow(_drawer(key), DRAWN), "surrogates")

    originals = entities.select(space, F.when(named, F.element_at(F.split("canon", ":"), -1)).otherwise(F.col("canon")).alias("word"),
                                F.lit(True).alias("taken")).distinct()
    state = draw(entities.withColumn("attempt", F.lit(0)))
    while True:
        clash = state.select("*", space, F.when(named, F.lower("new")).otherwise(F.col("new")).alias("word"))
        # the first draws keep theirs: the lowest attempt, then the smallest entity
        owner = clash.groupBy("space", "word").agg(F.min(F.struct("attempt", "kind", "canon")).alias("owner"))
        judged = clash.join(owner, ["space", "word"]).join(originals, ["space", "word"], "left")
        bad = (F.coalesce("taken", F.lit(False)) | (F.col("owner.canon") != F.col("canon")) | (F.col("owner.kind") != F.col("kind")))
        judged = materialize(judged.select(*state.columns, bad.alias("bad")), "surrogate-check")
        if not judged.filter("bad").take(1):
            return judged.drop("bad")
        again = draw(judged.filter("bad").withColumn("attempt", F.col("attempt") + 1))
        state = materialize(judged.filter("not bad").drop("bad").unionByName(again), "surrogate-state")


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, gender, host, attempt, new)`` with distinct surrogates that are no entity
    themselves: first of the domains, then of all else, addresses under their new domain.
    ``entities`` are ``(kind, canon)`` with the gender of names, if known; ``host`` is null where
    the domain kept its first draw."""
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit("u"))
    domain = F.element_at(F.split("canon", "@"), -1)
    none = F.lit(None).cast("string")
    domains = entities.filter("kind = 'email'").select(F.lit("domain").alias("kind"), domain.alias("canon")).distinct()
    hosts = _settled(domains.select("kind", "canon", F.lit("").alias("gender"), none.alias("host")), key)
    moved = hosts.filter("attempt > 0").select(F.col("canon").alias("domain"), F.col("new").alias("host"))
    mails = entities.filter("kind = 'email'").withColumn("domain", domain).join(moved, "domain", "left").drop("domain")
    rest = entities.filter("kind <> 'email'").withColumn("host", none)
    return _settled(mails.select(*rest.columns).unionByName(rest), key)


def _replacer(text_col: str, key: str, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text_col):
            texts = b.column(text_col)
            other = b.column("__drawn").to_pylist()
            new, n, kinds = [], [], []
            changed = {}
            for t, more in zip(texts, other):
                t = t.as_py()
                if not t:
                    new.append(t)
                    n.append(0)
                    kinds.append("")
                    continue
                out, found = replaced(t, {(x["kind"], x["canon"]): (x["attempt"], x["gender"], x["host"]) for x in more or ()}, key)
                new.append(out)
                n.append(len(found))
                kinds.append(",".join(sorted({k for _, _, k, _ in found})))
            if any(n):
                changed[text_col] = pa.array(new, texts.type)
                if "n_chars" in b.schema.names:
                    old = b.column("n_chars").to_pylist()
                    changed["n_chars"] = pa.array([len(x) if k else o for x, k, o in zip(new, n, old)], b.column("n_chars").type)
            names = [c for c in b.schema.names if c != "__drawn"]
            added = {"n_entities": pa.array(n, pa.int64()), "entity_kinds": pa.array(kinds, pa.string())} if report else {}
            yield pa.RecordBatch.from_arrays([*(changed.get(c, b.column(c)) for c in names), *added.values()],
                                             names=[*names, *added])
    return run


def session_key(spark: SparkSession) -> str:
    """The key set for the session, else a fresh one: surrogates of one run then agree with
    each other and with no other run's."""
    return spark.conf.get(KEY_SETTING, None) or token_hex(32)


def anonymize(docs: DataFrame, key: str, text_col: str = "text", report: bool = True) -> DataFrame:
    """``docs`` with entities replaced; ``report`` adds ``n_entities`` and ``entity_kinds``."""
    docs = docs.drop("n_entities", "entity_kinds") if report else docs
    mentions = materialize(docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
                           .mapInArrow(_finder, "text_hash long, kind string, canon string, gender string").distinct(), "mentions")
    told = F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender")))
    entities = mentions.groupBy("kind", "canon").agg(told.alias("told")).select(
        "kind", "canon", F.when(F.size("told") == 1, F.element_at("told", 1)).when(F.col("kind").isin(*NAMES), F.lit("u"))
        .otherwise(F.lit("")).alias("gender"))
    final = attempts(materialize(entities, "entities"), key)
    final = final.withColumnRenamed("gender", "settled")
    other = mentions.join(final, ["kind", "canon"]).filter(
        (F.col("attempt") > 0) | (F.col("gender") != F.col("settled")) | F.col("host").isNotNull())
    redrawn = other.groupBy(F.col("text_hash").alias("__text_hash")).agg(
        F.collect_list(F.struct("kind", "canon", "attempt", F.col("settled").alias("gender"), "host")).alias("__drawn"))
    redrawn = materialize(redrawn, "redrawn")
    schema = with_fields(docs.schema, "n_entities long, entity_kinds string") if report else docs.schema
    rows = docs.join(redrawn, F.xxhash64(text_col) == F.col("__text_hash"), "left").drop("__text_hash")
    return rows.mapInArrow(_replacer(text_col, key, report), schema)
