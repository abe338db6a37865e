"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text of more than ``PIECE`` characters is cut at safe boundaries first: before a single space between two
letters or digits, where the splitting pattern always ends one match and begins the next, so the ids of the
pieces in order are those of the whole. Decoding joins raw bytes, so ids that split a character decode rightly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes, on_worker

#: Characters of a piece, about.
PIECE = 65_536
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_loaded: dict = {}


def load_encoding(path: str, pattern: str):
    """The encoding of a rank file (lines of base64 bytes and a rank), without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of ``text``, cut at the first safe boundary after each ``size`` characters; one part where there is none."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(encoding, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in encoding.encode_ordinary(p)]


def encode(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """doc_id, the ``keep`` columns, and ids (array<int>) of every whole text.

    ``path`` is the rank file's place on every executor; each match of ``pattern`` is encoded separately and
    strings of special tokens are ordinary text. Null counts as empty and gives an empty array. One row comes out for each row that
    goes in; null ids and repeated rows stay; columns not named are ignored. An empty table gives an empty result.
    """
    kept = [documents.schema[c] for c in keep]
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_column].dataType), *kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = on_worker(_loaded, (path, pattern), lambda: load_encoding(path, pattern))
        for batch in by_bytes(batches, len(schema) - 1):
            ids = [np.array(encode_text(enc, t, piece), dtype=np.int32) for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=schema.names)

    rows = documents.select(F.col(id_column).alias("doc_id"), *[F.col(c) for c in keep], F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the raw bytes of ids. Null ids decode to null; an unknown id is an error."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    where = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = on_worker(_loaded, (path, pattern), lambda: load_encoding(path, pattern))
        for batch in by_bytes(batches, where):
            out = [None if x is None else enc.decode_bytes(x) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256."""
    schema = T.StructType([decoded.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    rows = decoded.select("doc_id", "ids", F.sha2("decoded", 256).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()  # of a slice: not from 0
            values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype("<u4")
            offsets = offsets - offsets[0]
            n = np.diff(offsets)
            hexes = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hexes), batch.column(2)], names=schema.names)

    return rows.mapInArrow(run, schema)
