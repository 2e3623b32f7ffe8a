"""Tokenizer training inputs and use (B1-B12) as DataFrame operators."""
from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import ranked_rows
from ..functions.text import EOT_ID, PAD_ID, SPECIAL_TOKENS, byte_ids, pieces, word_count
from ..session import stored
from .bpe import BpeModel, MergeTable

TRAIN_CHAR_CAP = 5000  # B2: code points of each document seen by the trainer (fixed value)


def blend(corpus: DataFrame, docs_per_source: int | None = None) -> DataFrame:
    """B1 + A3 cap: round-robin blend of the sources.

    ``k`` is the 0-based position of a doc inside its source; the blend order
    is ``(k, ord)``. Exhausted sources simply have no more ``k`` values, which
    is exactly the reference's drop-out rule. Only keys go through the
    ranking; rows that share a key are numbered by the hash of their text.
    """
    t = corpus.withColumn("__tie", F.xxhash64("text"))
    return ranked_rows(t, ["source"], "doc_id", "k", docs_per_source, tie=["__tie"]).drop("__tie")


def cap_chars(df: DataFrame, n: int = TRAIN_CHAR_CAP, text: str = "text") -> DataFrame:
    """B2: first ``n`` code points (Spark ``substring`` counts code points)."""
    return df.withColumn(text, F.substring(F.col(text), 1, n))


def explode_pieces(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per piece, ``pos`` its 0-based place in the document."""
    return df.select(*keys, F.posexplode(pieces(F.col(text))).alias("pos", "piece"))


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(piece, n)`` over the blend; partial + final hash aggregate."""
    return (df.select(F.explode(pieces(F.col(text))).alias("piece"))
            .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))


def training_pieces(corpus: DataFrame, docs_per_source: int | None = None) -> DataFrame:
    """B1 -> B2 -> B4: the piece table the merge learner starts from. Counts do
    not depend on the blend order, only on which documents are in it."""
    from ..sources.corpus import cap_per_source
    return piece_counts(cap_chars(cap_per_source(corpus, docs_per_source)))


def _gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``index`` of a flat list array one after another, and their ends."""
    size = (offsets[1:] - offsets[:-1])[index]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(offsets[index] - ends[:-1], size) + np.arange(ends[-1])], ends


def _encode_lists(column, table: MergeTable) -> pa.ListArray:
    """Piece lists to id lists: every distinct piece of the batch is encoded once."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    words = column.flatten()
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not len(words):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(column) + 1, np.int32)), pa.array([], pa.int32()))
    coded = words.dictionary_encode()
    flat, ends = _gather(*table.encode(coded.dictionary), coded.indices.to_numpy())
    rows = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, model: BpeModel | None, keys: Sequence[str], text: str | Sequence[str] = "text",
           out: str | Sequence[str] = "ids") -> DataFrame:
    """Text -> token ids, no special tokens added; ``keys`` may be any columns
    to carry along. Several text columns are encoded in one pass.

    Without merges the ids are the UTF-8 bytes, computed in place (JVM). With
    merges the pieces are cut JVM-side (``regexp_extract_all``); an Arrow batch
    is then flattened, each of its distinct pieces encoded once, and the id
    lists rebuilt by index. No row leaves its partition.
    """
    keys = list(keys)
    texts, outs = ([text], [out]) if isinstance(text, str) else (list(text), list(out))
    if model is None or not model.merges:
        return df.select(*keys, *[byte_ids(F.col(t)).alias(o) for t, o in zip(texts, outs)])
    table = MergeTable(model.merges)
    cut = [f"__pieces{i}" for i in range(len(texts))]
    src = df.select(*keys, *[pieces(F.coalesce(F.col(t), F.lit(""))).alias(c) for t, c in zip(texts, cut)])
    schema = T.StructType([*(src.schema[k] for k in keys),
                           *(T.StructField(o, T.ArrayType(T.IntegerType())) for o in outs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), *(_encode_lists(b.column(c), table) for c in cut)],
                names=[*keys, *outs])

    return src.mapInArrow(run, schema)


class PieceDictionary:
    """The pieces a tokenizer has encoded so far with their ids, as batches in a folder of the
    tokenizer's own hash. A piece is encoded once however many documents, runs or
    sessions bring it; another tokenizer has another folder.

    ``encode`` needs a shuffle of the pieces, which the batch-local ``encode`` above does not;
    it pays where pieces come again and encoding them is the greater part. ``number`` cuts the
    texts once for both ``extend`` and ``encode``."""

    SCHEMA = "piece string, ids array<int>"

    def __init__(self, spark: SparkSession, path: str, model: BpeModel):
        self.spark, self.model = spark, model
        name = hashlib.sha256(",".join(f"{a}:{b}" for a, b in model.merges).encode()).hexdigest()[:24]
        self.path = f"{path}/{name}"

    def rows(self) -> DataFrame:
        """``(piece, ids)``, once each, of committed batches."""
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/*").dropDuplicates(["piece"])
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def number(self, df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
        """The texts cut to pieces, stored: chunks of documents, each a list of its distinct pieces
        (``__words``, beside its first document) and documents as numbers in that list (``__at``).
        ``extend`` and ``encode`` take it in place of the texts."""
        src = df.select(*keys, pieces(F.coalesce(F.col(text), F.lit(""))).alias("__pieces"))
        schema = T.StructType([*(src.schema[k] for k in keys), T.StructField("__chunk", T.LongType()),
                               T.StructField("__at", T.ArrayType(T.IntegerType())), T.StructField("__words", T.ArrayType(T.StringType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 32
            for b in batches:
                for part in _chunks(b, "__pieces"):
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k) for k in keys), pa.array(np.full(len(part), chunk)), *_numbered(part.column("__pieces"))],
                        names=schema.names)
                    chunk += 1

        return stored(src.mapInArrow(run, schema), "numbered")

    def extend(self, df: DataFrame, text: str = "text") -> int:
        """Encode the pieces of ``df`` that are not in the dictionary; returns how many."""
        table = MergeTable(self.model.merges)
        found = F.col("__words") if "__words" in df.columns else pieces(F.col(text))
        new = df.select(F.explode(found).alias("piece")).distinct().join(self.rows(), "piece", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat, ends = table.encode(b.column("piece"))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("piece"), ids], names=["piece", "ids"])

        count = Observation()
        (new.mapInArrow(run, self.SCHEMA).observe(count, F.count(F.lit(1)).alias("n"))
         .write.parquet(f"{self.path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"))
        return count.get["n"]

    def encode(self, df: DataFrame, keys: Sequence[str], text: str = "text", out: str = "ids") -> DataFrame:
        """B8 by look-up: chunks of documents ask for their distinct pieces, which meet their ids in one
        join, and the answers go back to the chunk; neither a piece nor a key is repeated for every
        token. All pieces of ``df`` must be in the dictionary; ``keys`` are carried along."""
        keys = list(keys)
        docs = (df if "__words" in df.columns else self.number(df, keys, text)).select(*keys, "__chunk", "__at", "__words")
        asked = docs.select(F.col("__chunk").alias("__for"), F.posexplode("__words").alias("__no", "piece"))
        missing = F.raise_error(F.concat(F.lit("piece not in the dictionary: "), "piece")).cast("array<int>")
        answers = asked.join(self.rows(), "piece", "left").select(
            "__for", "__no", F.when(F.col("ids").isNull(), missing).otherwise(F.col("ids")).alias("__ids"))
        schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField(out, T.ArrayType(T.IntegerType()))])

        def meet(part: pa.Table, found: pa.Table) -> pa.Table:
            return pa.Table.from_arrays([*(part.column(k) for k in keys), _looked_up(part.column("__at"), found)], names=[*keys, out])

        return docs.drop("__words").groupBy("__chunk").cogroup(answers.groupBy("__for")).applyInArrow(meet, schema)


CHUNK_PIECES = 1 << 20      # pieces of the documents that ask together


def _chunks(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut to about ``CHUNK_PIECES`` pieces each; a document stays whole."""
    ends = np.cumsum(pa.compute.list_value_length(b.column(column)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // CHUNK_PIECES)) + 1 if len(b) else []
    for i, j in zip([0, *cuts], [*cuts, len(b)]):
        if i < j:
            yield b.slice(i, j - i)


def _numbered(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Piece lists as numbers in the list of their distinct pieces, and that list beside the first one."""
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
    at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.indices)
    first = np.full(len(lists) + 1, len(coded.dictionary))
    first[0] = 0
    words = pa.ListArray.from_arrays(pa.array(first, pa.int32()), coded.dictionary, mask=pa.array(np.arange(len(lists)) > 0))
    return at, words


def _looked_up(at: pa.ChunkedArray, answers: pa.Table) -> pa.ListArray:
    """Id lists of documents from the numbers of their pieces and the ids that answer each number."""
    at = at.combine_chunks()
    rows = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(at).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not rows[-1]:
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array([], pa.int32()))
    found = answers.column("__ids").combine_chunks()
    place = np.argsort(answers.column("__no").to_numpy())             # a chunk asks for each of its numbers once
    size = pa.compute.list_value_length(found).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat, ends = _gather(found.flatten().to_numpy(), offsets, place[at.flatten().to_numpy()])
    return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(flat, pa.int32()))


def decode(df: DataFrame, model: BpeModel | None, keys: Sequence[str], ids: str = "ids",
           out: str = "text") -> DataFrame:
    """Ids -> text. Specials are dropped; a cut character decodes to U+FFFD.

    The vocabulary (<= 65,536 entries by the id guard) is one Arrow array; the
    tokens of a batch are taken from it at once, and a document is the slice
    of the taken bytes between its ends. No explode, no shuffle."""
    keys = list(keys)
    tokens = (model or BpeModel()).token_bytes()
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("__raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pa.array(tokens, pa.large_binary())
        for b in batches:
            column = b.column(ids)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            taken = vocab.take(column.flatten())
            _, off, data = taken.buffers()
            at = np.frombuffer(off, np.int64, len(taken) + 1)[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            raw = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at.tobytes()), data])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), raw.cast(pa.binary())], names=[*keys, "__raw"])

    text = F.make_valid_utf8(F.col("__raw").cast("string"))
    return df.select(*keys, ids).mapInArrow(run, schema).select(*keys, text.alias(out))


def roundtrip_audit(corpus: DataFrame, model: BpeModel | None) -> DataFrame:
    """Per source, how many documents do not decode back to their text, and the sum of the
    decoded texts' digests (their first 32 bits), which any other reader of the texts can form."""
    both = corpus.select("source", "text", F.col("text").alias("__in"))
    enc = encode(both, model, ["source", "text"], text="__in")
    dec = decode(enc, model, ["source", "text"], out="decoded")
    digest = F.conv(F.substring(F.md5("decoded"), 1, 8), 16, 10).cast("bigint")
    return dec.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.when(F.col("decoded").eqNullSafe(F.col("text")), 0).otherwise(1))
         .cast("bigint").alias("mismatched"), F.sum(digest).alias("digest_sum"))


def fertility(corpus: DataFrame, model: BpeModel | None) -> DataFrame:
    """Tokens per whitespace-separated word, per source."""
    t = corpus.select("source", "text", word_count(F.col("text")).alias("words"))
    return encode(t, model, ["source", "words"]).groupBy("source").agg(
        F.sum(F.size("ids")).cast("bigint").alias("tokens"),
        F.sum("words").cast("bigint").alias("words"),
        F.round(F.sum(F.size("ids")) / F.sum("words"), 6).alias("fertility"))


def special_audit(vocab: DataFrame, declared: DataFrame) -> DataFrame:
    """Whether each declared special (``text``) resolves to an id in a stored vocabulary
    table (``id, token_hex, special, text``)."""
    found = vocab.filter("special").select("text", "id")
    return declared.select("text").distinct().join(found, "text", "left").select(
        "text", "id", F.col("id").isNotNull().alias("resolved"))


def reserved_specials(spark: SparkSession) -> DataFrame:
    """``(text, declared)``: every reserved special and the id it is declared with."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(SPECIAL_TOKENS)], "text string, declared int")


def declared_specials(conversations: DataFrame) -> DataFrame:
    """The specials that chats call for: one for each role, end of text and padding."""
    roles = conversations.filter("role is not null").select(F.concat(F.lit("<|"), "role", F.lit("|>")).alias("text"))
    fixed = conversations.sparkSession.createDataFrame([(SPECIAL_TOKENS[EOT_ID],), (SPECIAL_TOKENS[PAD_ID],)], "text string")
    return roles.distinct().unionByName(fixed).distinct()
