"""Scalar text helpers with Python string semantics, as JVM-side expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing runs Python per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
# Python's str.isspace() set is Java's (?U)\s plus the four separators
# U+001C..U+001F; the class below is the Python whitespace class in Java regex.
PY_SPACE = r"[\s\x1c-\x1f]"
PY_NONSPACE = r"[^\s\x1c-\x1f]"

# Byte-level pre-tokenizer pattern (fixed value): contractions, optional-space
# letter runs, optional-space digit runs, optional-space other runs, whitespace
# not followed by non-space, then any whitespace run.
PIECE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                 r"|\s+(?!\S)|\s+")

# Reserved tokens, ids 0..4 in this order (fixed values).
SPECIAL_TOKENS = ("<|endoftext|>", "<|pad|>", "<|system|>", "<|user|>", "<|assistant|>")
N_SPECIAL = len(SPECIAL_TOKENS)
BYTE_OFFSET = N_SPECIAL          # byte b has id 5 + b
FIRST_MERGE_ID = N_SPECIAL + 256  # merge of rank r has id 261 + r
EOT_ID, PAD_ID, SYSTEM_ID, USER_ID, ASSISTANT_ID = range(N_SPECIAL)
# -------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c) -> Column:
    """Python truthiness of an optional string: not None and not ''."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def py_strip(c) -> Column:
    """``str.strip()``: trims Python whitespace at both ends (``trim`` trims spaces only)."""
    return F.regexp_replace(_c(c), r"(?U)^" + PY_SPACE + r"+|" + PY_SPACE + r"+$", "")


def is_blank(c) -> Column:
    """True when the stripped string is empty or the value is null."""
    return ~F.coalesce(_c(c).rlike(r"(?U)" + PY_NONSPACE), F.lit(False))


def capitalize(c) -> Column:
    """``str.capitalize()``: first character upper, the rest lower (not ``initcap``)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def word_count(c) -> Column:
    """``len(s.split())``: number of maximal non-whitespace runs."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(r"(?U)" + PY_NONSPACE + "+"), F.lit(0)))


def pieces(c) -> Column:
    """Lossless byte-level pre-tokenization into an array of string pieces."""
    return F.regexp_extract_all(_c(c), F.lit("(?U)" + PIECE_PATTERN), F.lit(0))


def byte_ids(c) -> Column:
    """Byte-level token ids (``5 + byte``) of a string, no merges applied.

    The UTF-8 bytes are re-read as ISO-8859-1, where every byte is exactly one
    character whose code point is the byte value; splitting into characters
    and taking code points stays a linear, JVM-side pass."""
    raw = F.decode(F.encode(_c(c), "UTF-8"), "ISO-8859-1")
    ids = F.transform(F.split(raw, "", -1), lambda ch: F.ascii(ch) + F.lit(BYTE_OFFSET))
    return F.when(F.length(raw) == 0, F.array().cast("array<int>")).otherwise(ids)


def ids_string(c) -> Column:
    """Space-joined id list: the flat form used in oracle comparisons."""
    return F.array_join(_c(c).cast("array<string>"), " ")


def r6(c) -> Column:
    """Doubles leave every report rounded to six places."""
    return F.round(_c(c).cast("double"), 6)
