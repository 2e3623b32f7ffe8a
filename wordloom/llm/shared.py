"""Helpers shared by the operators of this package: shared-folder tables and byte-level words."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

# Word bytes (fixed values): the complement of [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z -> a-z.
WORD_LUT = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _l = _b + 32 if 0x41 <= _b <= 0x5A else _b
    if 0x30 <= _l <= 0x39 or 0x61 <= _l <= 0x7A or _l >= 0x80:
        WORD_LUT[_b] = _l
WORD_TABLE = bytes(int(x) or 0x20 for x in WORD_LUT)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MAX_POW = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage,
    survives lost executors, keeps columns prunable and gives Spark a true size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` with further fields; names given again are replaced."""
    more = StructType.fromDDL(ddl).fields
    names = {f.name for f in more}
    return StructType([*(f for f in schema.fields if f.name not in names), *more])


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of an Arrow string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, limit: int = _MAX_POW):
    """Row ranges ``(i, j)`` of at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = max(i + 1, min(j, n))
        yield i, j
        i = j


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 * _MAX_POW) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``limit`` bytes of text each, one row at least, so that what a
    worker builds from a batch follows the limit. Memory goes back to the system at the end:
    workers live on between tasks."""
    for b in batches:
        _, offsets = text_bytes(b.column(column))
        for i, j in row_slices(offsets, limit):
            yield b.slice(i, j - i)
    release()


def release() -> None:
    """Give freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):         # another C library
        pass


def mix64(h: np.ndarray) -> np.ndarray:
    """The 64-bit avalanche step (public-domain murmur finaliser constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        inv = pow(int(_BASE), -1, 1 << 64)
        ones = np.full(_MAX_POW + 1, _BASE, dtype=np.uint64)
        ones[0] = 1
        _POWERS["up"] = np.multiply.accumulate(ones)
        ones = np.full(_MAX_POW + 1, np.uint64(inv), dtype=np.uint64)
        ones[0] = 1
        _POWERS["down"] = np.multiply.accumulate(ones)
    return _POWERS["up"], _POWERS["down"]


def _words_of(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a mapped buffer (0 = no word byte); ``cuts`` are row starts."""
    n = len(x)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    w = x != 0
    first = w.copy()
    first[1:] &= ~w[:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = w[cuts]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cuts - 1] = w[cuts - 1]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    up, down = _powers()
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum(x * up[:n], out=acc[1:])
    h = mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64))
    return s, e, h


def hashed_words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = WORD_LUT):
    """Words of the rows of ``text_bytes``: ``(row, start, end, hash)``; start and end are
    byte offsets inside the row's text. ``lut`` maps a byte to its folded value, 0 where it
    parts words. Long texts are cut at non-word bytes, so memory follows the slice, not the
    text; whole texts are read."""
    rows, starts, ends, hashes = [], [], [], []
    for i, j in row_slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        cuts = offsets[i:j] - lo
        at = lo
        while at < hi:
            to = min(hi, at + _MAX_POW)
            x = lut[data[at:to]]
            if to < hi:                       # one row longer than a slice
                gaps = np.flatnonzero(x == 0)
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                    x = x[:to - at]
                else:                         # a word longer than a slice
                    s, to, h = _long_word(data, at, hi, lut)
                    rows.append(np.full(1, i, np.int64))
                    starts.append(np.array([s - lo]))
                    ends.append(np.array([to - lo]))
                    hashes.append(np.array([h], np.uint64))
                    at = to
                    continue
            s, e, h = _words_of(x, cuts + lo - at)
            r = np.searchsorted(cuts, s + (at - lo), side="right") - 1
            rows.append(r + i)
            starts.append(s + (at - lo) - cuts[r])
            ends.append(e + (at - lo) - cuts[r])
            hashes.append(h)
            at = to
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return (np.concatenate(rows), np.concatenate(starts), np.concatenate(ends),
            np.concatenate(hashes))


def _long_word(data: np.ndarray, at: int, hi: int, lut: np.ndarray) -> tuple[int, int, int]:
    import hashlib
    to, digest = at, hashlib.blake2b(digest_size=8)
    while to < hi:
        x = lut[data[to:min(hi, to + _MAX_POW)]]
        gaps = np.flatnonzero(x == 0)
        n = int(gaps[0]) if len(gaps) else len(x)
        digest.update(x[:n].tobytes())
        to += n
        if len(gaps):
            break
    return at, to, int.from_bytes(digest.digest(), "little")


def word_list(text: bytes | str | None) -> list[bytes]:
    """The words of one text, in order (the plain form of ``hashed_words``)."""
    if text is None:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(WORD_TABLE).split()
