"""Token ids of every text by a public byte-level tokenizer.

Texts longer than ``CHUNK`` characters are cut into overlapping chunks that are
pre-tokenised in parallel. Two neighbours are stitched at the first boundary in
their overlap that both have and that no context can move; the pieces between
the stitches are encoded on their own, and their ids are joined in order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import spread

CHUNK = 16_384
OVERLAP = 1_024
#: A match that ends this near to a chunk's end may end elsewhere in the whole text.
EDGE = 4

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRE = regex.compile(PATTERN)
# Boundaries in any reading: a run of letters, digits or other marks never goes on as another kind; only an apostrophe may take letters in.
_FIRM = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


def default_vocabulary() -> str:
    """The installed public rank file of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder(vocabulary: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str) -> np.ndarray:
    return encoder(vocabulary).encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


def decode(ids: list[int], vocabulary: str) -> str:
    """The text of ids: their bytes, joined and read as UTF-8."""
    return encoder(vocabulary).decode_bytes(ids).decode("utf-8")


def _firm_boundaries(chunk: str, lo: int, hi: int, at_end: bool) -> list[int]:
    """Boundaries of the chunk's own pre-tokens in [lo, hi) that no context can move."""
    last = len(chunk) if at_end else len(chunk) - EDGE
    hi = min(hi, last)
    own = {m.end() for m in _PRE.finditer(chunk) if lo <= m.end() < hi}
    return [m.start() for m in _FIRM.finditer(chunk, max(lo - 1, 0), min(hi + 1, len(chunk))) if m.start() in own]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the digest of their whole text, which tells texts of equal or null ids apart."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.binary()), ("k", pa.int64()), ("last", pa.bool_()), ("chunk", pa.string())])
    for batch in batches:
        for i, text in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            n = -(-len(text) // CHUNK)
            row = hashlib.blake2b(text.encode(), digest_size=16).digest()
            for k in range(n):
                part = text[k * CHUNK : (k + 1) * CHUNK + OVERLAP]
                yield pa.RecordBatch.from_pylist([{"id": i, "row": row, "k": k, "last": k == n - 1, "chunk": part}], schema=schema)


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks, each with its firm boundaries in the overlaps before and after it, as places in the whole text."""
    places = pa.list_(pa.int64())
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            heads, tails = [], []
            for k, last, chunk in zip(*(part.column(c).to_pylist() for c in ("k", "last", "chunk")), strict=True):
                at = k * CHUNK
                heads.append([at + b for b in _firm_boundaries(chunk, 1, OVERLAP, last)] if k else [])
                tails.append([] if last else [at + b for b in _firm_boundaries(chunk, CHUNK, CHUNK + OVERLAP, False)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, places), pa.array(tails, places)], names=[*part.schema.names, "heads", "tails"])


def _encode_batches(vocabulary: str, count_only: bool, keys: int):
    """(keys…, text) → (keys…, ids) or (keys…, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k) for k in range(keys)]
            ids = [encode(t, vocabulary) for t in batch.column(keys).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if count_only:
                out = pa.array(sizes, pa.int64())
            else:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*own, out], names=[*batch.schema.names[:keys], "out"])

    return run


def _pieces(long_texts: DataFrame) -> DataFrame:
    """(id, text) of long texts → (id, row, copies, piece, text), each piece encodable on its own.

    Texts are known by id and digest, so that any part can be computed again
    elsewhere and comes out alike; rows with the same id and text are worked on
    once, and ``copies`` tells how many they are. Chunks carry their own
    boundaries on, so that they are read once and never joined to themselves.
    """
    chunks = long_texts.mapInArrow(_cut, "id long, row binary, k long, last boolean, chunk string").groupBy("id", "row", "k").agg(F.first("last").alias("last"), F.first("chunk").alias("chunk"), F.count("*").alias("copies"))
    bounds = chunks.select("id", "row", "k", "last", "chunk", "copies").mapInArrow(_bounds, "id long, row binary, k long, last boolean, chunk string, copies long, heads array<long>, tails array<long>")
    by_text = Window.partitionBy("id", "row").orderBy("k")
    stitched = bounds.select("id", "row", "k", "last", "chunk", "copies", F.array_min(F.array_intersect(F.lag("tails").over(by_text), "heads")).alias("sync"))
    stitched = stitched.select("*", F.lead("sync").over(by_text).alias("next"), F.count("sync").over(by_text.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"))
    at = F.col("k") * CHUNK
    start = F.coalesce(F.col("sync") - at, F.lit(0))
    stop = F.when(F.col("last"), F.length("chunk")).otherwise(F.coalesce(F.col("next") - at, F.lit(CHUNK)))
    part = F.substring(F.col("chunk"), (start + 1).cast("int"), (stop - start).cast("int"))
    parts = stitched.select("id", "row", "piece", "k", "copies", part.alias("part")).repartition("id", "row", "piece")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("id", "row", "piece").agg(F.first("copies").alias("copies"), whole.alias("text")).select("id", "row", "copies", "piece", "text")


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, count_only: bool = False, out_name: str | None = None) -> DataFrame:
    """Rows (id, ids) or, with ``count_only``, (id, n_tokens), one for each row of ``df``.

    Null and empty texts have an empty list, or 0 tokens; strings of special
    tokens are ordinary text. Repeated rows come out as often as they come in,
    also where their texts are long; other columns are not looked at.
    """
    vocabulary = vocabulary or default_vocabulary()
    out_name = out_name or ("n_tokens" if count_only else "ids")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.length("text") > CHUNK
    kind = "long" if count_only else "array<int>"
    short = spread(src.where(~F.coalesce(is_long, F.lit(False))), "id").mapInArrow(_encode_batches(vocabulary, count_only, 1), f"id long, out {kind}")
    pieces = _pieces(src.where(is_long)).mapInArrow(_encode_batches(vocabulary, count_only, 4), f"id long, row binary, copies long, piece long, out {kind}")
    if count_only:
        joined = F.sum("out")
    else:
        joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "out"))), lambda p: p["out"]))
    whole = pieces.groupBy("id", "row").agg(F.first("copies").alias("copies"), joined.alias("out"))
    whole = whole.select("id", "out", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return short.unionByName(whole.select("id", "out")).select(F.col("id").alias(id_col), F.col("out").alias(out_name))


def _decode_batches(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else enc.decode_bytes(ids).decode("utf-8") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode_column(df: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None, out_name: str = "text") -> DataFrame:
    """Rows (id, text): the bytes of the ids, joined and read as UTF-8; an empty list gives an empty text, a null one null. Ids that the vocabulary lacks, or bytes that are no text, are an error."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(_decode_batches(vocabulary or default_vocabulary()), "id long, text string").select(F.col("id").alias(id_col), F.col("text").alias(out_name))
