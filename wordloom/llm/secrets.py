"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger, a Parquet
folder in shared storage, holds one row per (blob, rule version) scanned, with its findings.
A scan reads only blobs whose pair with a rule version is not in the ledger - each distinct
content once, however many paths hold it - appends them as one committed batch, and joins
the findings back to all paths. Scanning again, or adding a rule version, reads nothing twice.

Batches are folders that count only once their ``_SUCCESS`` marker exists; a batch cut short
by a lost driver is scanned again. Repeated rows of a pair give the same findings, and the
reader drops repeats, so a batch committed twice changes nothing.

Defined cases: a null text is the empty blob; empty and very long texts are scanned whole;
null and repeated ids stay as rows; an empty table gives an empty result; further columns
are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIND_ORDER = ("assign", "access", "hex", "private_key", "jwt", "bearer", "url_password")

#: Rule versions: name -> kinds. A new version is scanned over all blobs once.
RULE_VERSIONS = {"base-1": ("assign", "access", "hex"),
                 "more-1": ("private_key", "jwt", "bearer", "url_password")}

# Patterns of the base kinds (fixed values) and of the added ones.
_FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")     # runs are maximal: the same as dropping shorter ones
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
BEARER = re.compile(r"(?:[Bb]earer|BEARER)\x20+([A-Za-z0-9._~+/-]{16,}=*)")
URL_PASSWORD = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,256}:([^\s/@]{3,256})@", _FLAGS)

_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def spans_of(text: str, kinds: tuple) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by code point, end exclusive; leftmost non-overlapping per kind."""
    out = []
    for kind in kinds:
        if kind == "assign":
            low = text.lower()
            if any(w in low for w in _ASSIGN_WORDS):
                out += [(m.start(), m.end(), kind) for m in ASSIGN.finditer(text)
                        if m.end(2) - m.start(2) >= 8]
        elif kind == "access":
            if "AKIA" in text:
                out += [(m.start(), m.end(), kind) for m in ACCESS.finditer(text)
                        if m.end() - m.start() >= 16]
        elif kind == "hex":
            out += [(m.start(), m.end(), kind) for m in HEX.finditer(text)]
        elif kind == "private_key":
            if "PRIVATE KEY-----" in text:
                out += [(m.start(), m.end(), kind) for m in PRIVATE_KEY.finditer(text)]
        elif kind == "jwt":
            if "eyJ" in text:
                out += [(m.start(), m.end(), kind) for m in JWT.finditer(text)]
        elif kind == "bearer":
            if "earer" in text or "EARER" in text:
                out += [(m.start(1), m.end(1), kind) for m in BEARER.finditer(text)]
        elif kind == "url_password" and "://" in text:
            out += [(m.start(1), m.end(1), kind) for m in URL_PASSWORD.finditer(text)]
    return out


FINDINGS = "array<struct<start:int,end:int,kind:string>>"
LEDGER_SCHEMA = f"blob string, rule_version string, findings {FINDINGS}"


def _scanner(rule_versions: dict):
    schema = pa.schema([("blob", pa.string()), ("rule_version", pa.string()),
                        ("findings", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                                         ("kind", pa.string())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs, versions, found = [], [], []
            for blob, text, todo in zip(b.column("blob").to_pylist(), b.column("text"),
                                        b.column("todo").to_pylist()):
                text = text.as_py()
                for v in todo:
                    blobs.append(blob)
                    versions.append(v)
                    found.append([{"start": s, "end": e, "kind": k}
                                  for s, e, k in spans_of(text, rule_versions[v])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array(versions, pa.string()),
                 pa.array(found, schema.field("findings").type)], schema=schema)

    return scan


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """The ledger folder: ``<path>/batch=<n>/`` with one row per (blob, rule version)."""

    def __init__(self, spark: SparkSession, path: str, rule_versions: dict | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.rule_versions = dict(rule_versions or RULE_VERSIONS)

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Committed batch folders, oldest first."""
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(f"{self.path}/{n}" for n in names if n.startswith("batch-")
                      and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def entries(self) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*done)

    def scan(self, versions: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
        """Scan what the ledger lacks and commit it as the next batch. ``versions`` has a row
        per (path, historical version); ``key_cols`` say which copy of a blob is read. Returns
        ``(key_cols..., blob)`` for joining findings back."""
        from .shared import materialize
        own_blob = blob_id(F.col(text_col))
        paths = materialize(versions.select(*key_cols, own_blob.alias("blob")), "blob-paths")
        seen = self.entries().groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        every = F.array(*[F.lit(v) for v in sorted(self.rule_versions)])
        blobs = (paths.groupBy("blob").agg(F.min(F.struct(*key_cols)).alias("key"))
                 .join(seen, "blob", "left"))
        todo = (blobs.select(F.col("blob").alias("__blob"), "key",
                             F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
                .filter(F.size("todo") > 0))
        todo = materialize(todo, "blob-todo")
        if not todo.take(1):
            return paths
        # The text of one copy of each pending blob: by its key and its content, so that rows of
        # one key, null or other, meet their own blobs only.
        same = F.col("blob") == F.col("__blob")
        for c in key_cols:
            same = same & F.col("key")[c].eqNullSafe(F.col(f"__{c}"))
        texts = versions.select(*[F.col(c).alias(f"__{c}") for c in key_cols], own_blob.alias("blob"),
                                F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        pending = texts.join(todo, same, "inner").select("blob", "text", "todo")
        batch = f"{self.path}/batch-{len(self.batches()):06d}"
        (pending.mapInArrow(_scanner(self.rule_versions), LEDGER_SCHEMA)
         .write.mode("overwrite").parquet(batch))
        return paths

    def findings(self, rule_versions: list[str] | None = None) -> DataFrame:
        """``(blob, spans)`` of blobs with findings: spans by start, then kind as listed."""
        e = self.entries().filter(F.col("rule_version").isin(*(rule_versions or self.rule_versions)))
        e = e.filter(F.size("findings") > 0).dropDuplicates(["blob", "rule_version"])
        rank = F.map_from_arrays(F.array(*[F.lit(k) for k in KIND_ORDER]),
                                 F.array(*[F.lit(i) for i in range(len(KIND_ORDER))]))
        flat = e.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("f"))
        return flat.select("blob", F.array_sort(F.transform("f", lambda x: F.struct(
            x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"),
            x["end"].alias("end"), x["kind"].alias("kind")))).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, ledger: BlobLedger, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Findings of every path, clean ones included: counts and spans per row of ``docs``."""
    paths = ledger.scan(docs, [id_col], text_col)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    rows = paths.join(ledger.findings(), "blob", "left")
    spans = F.coalesce(F.col("spans"), none)
    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    rows = rows.select(F.col(id_col), F.col("blob"), spans.alias("spans"), base.alias("base"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        id_col, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), "blob")


def plain_base(text: str | None) -> str:
    """The base spans of one text as ``kind:start:end``, without ledger (for tests)."""
    spans = spans_of(text or "", RULE_VERSIONS["base-1"])
    spans.sort(key=lambda s: (s[0], KIND_ORDER.index(s[2])))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def plain_digest(text: str | None) -> str:
    return hashlib.sha256(plain_base(text).encode()).hexdigest()
