"""Token ids as files: a concatenated id array per segment, with Elias-Fano coded document boundaries.

Documents are put in ascending id order by a range exchange, encoded, and packed into segments of about ``SEGMENT_IDS`` ids.
A segment is one row of a Parquet file that Spark's committed writer makes, so it works on any file system and survives
lost tasks. Its cells are the file format:

* ``ids``: the ids of its documents, one after another, as little-endian unsigned integers of ``width`` bytes
  (2 where every id of the vocabulary and the end id fit, else 4).
* ``low``, ``high``: the ends of the documents within ``ids`` (a non-decreasing sequence of n_docs numbers up to n_ids)
  in Elias-Fano form: ``low_bits`` = floor(log2(n_ids / n_docs)) low bits of each, packed little-endian; the rest in unary: bit
  (end >> low_bits) + i of ``high`` is set for the i-th. About 2 + log2(n_ids / n_docs) bits a document, and no table of 64-bit offsets.
* ``n_null``, ``first_doc``, ``doc_low_bits``, ``doc_low``, ``doc_high``: how many documents without an id come first, and the other documents' ids,
  less the first of them, in the same form.

A select over ``high`` gives any document's offset: one 32-bit count of set bits is kept for each 512 bits, then bytes are counted, then bits.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_bytes, on_worker
from .units import Units, cuts_at_units, settings_of

#: Ids in a segment, about; bytes of texts that are encoded at once.
SEGMENT_IDS, TEXT_BYTES = 1 << 18, 8 << 20
#: Segments whose starts are broadcast (24 bytes each); beyond that they are joined by a shuffle.
STARTS = 500_000
_loaded: dict = {}
_SCHEMA = "part int, segment int, n_docs long, n_ids long, width int, low_bits int, low binary, high binary, n_null long, first_doc long, doc_low_bits int, doc_low binary, doc_high binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of n unsigned 64-bit numbers, with select."""

    #: Bytes of ``high`` between two counts, and numbers that are selected at once.
    SAMPLED, AT_ONCE = 64, 4096

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high + bytes(-len(high) % self.SAMPLED), dtype=np.uint8)
        per = np.bitwise_count(self.high).reshape(-1, self.SAMPLED).sum(axis=1, dtype=np.uint32)
        self.before = np.cumsum(per, dtype=np.uint32) - per

    @staticmethod
    def encode(values: np.ndarray, most: int) -> tuple[int, bytes, bytes]:
        """(low_bits, low, high) of ``values``, none of which is more than ``most``."""
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        bits = max(0, (most // n).bit_length() - 1) if n and most else 0
        lows = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        high = np.zeros((most >> bits) + n + 1, dtype=np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return bits, np.packbits(lows, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers (from 0)."""
        i = np.asarray(i, dtype=np.int64)
        parts = [self._some(i[k : k + self.AT_ONCE]) for k in range(0, len(i), self.AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def _some(self, i: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, i.astype(np.uint32), side="right") - 1
        left = (i - self.before[block]).astype(np.int64)
        ones = np.cumsum(np.bitwise_count(self.high.reshape(-1, self.SAMPLED)[block]), axis=1, dtype=np.int64)
        byte = np.argmax(ones > left[:, None], axis=1)
        left -= np.where(byte > 0, ones[np.arange(len(i)), np.maximum(byte - 1, 0)], 0)
        byte += self.SAMPLED * block
        bits = (self.high[byte][:, None] >> np.arange(8, dtype=np.uint8)) & 1
        place = 8 * byte + np.argmax(np.cumsum(bits, axis=1) == (left + 1)[:, None], axis=1)
        upper = (place - i).astype(np.uint64)
        if not self.low_bits:
            return upper
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)
        return (upper << np.uint64(self.low_bits)) | low.sum(axis=1, dtype=np.uint64)


#: Words of composed lower-case Latin letters: normalising leaves them as they are.
_LOWER_WORD = re.compile(r" ?[a-z\xdf-\xf6\xf8-\xff]+")


class Encoder:
    """Ids of whole texts, each followed by the end id, by a vocabulary of the tokenizers library."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.end = end_id
        self.width = 2 if max(end_id, tok.get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.encode = ids_of(tok)
        settings = settings_of(tok)
        self.units, self.fold = None, False
        if not cuts_at_units(settings):
            return
        self.fold = settings["normalizer"] is not None  # the one known normaliser lower-cases and the pre-splitting drops white space
        between = " | " if self.fold else "\n"
        if len(self.encode([between])[0]) != 1:
            return
        if self.fold:
            # the same model without the steps that leave such words as they are
            lean = Tokenizer(tok.model)
            lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.units = Units(self.encode, between, self.kind, ids_of(lean), _LOWER_WORD)
        else:
            self.units = Units(self.encode, between, self.kind)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another with their end ids; how many each text has) of a column without nulls."""
        if self.units is not None:
            flat, size = self.units.ids(column, self.fold)
        else:
            each = self.encode(column.to_pylist())
            size = np.array([len(x) for x in each], dtype=np.int64)
            flat = np.array([i for x in each for i in x], dtype=self.kind)
        return np.insert(flat, np.cumsum(size), self.end), size + 1


def ids_of(tokenizer):
    return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _Segment:
    """Documents that are put together until there are enough."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.names: list[pa.Array] = []
        self.n_ids = 0

    def add(self, ids: np.ndarray, size: np.ndarray, names: pa.Array) -> None:
        self.ids.append(ids)
        self.sizes.append(size)
        self.names.append(names)
        self.n_ids += len(ids)

    def row(self, part: int, segment: int, width: int) -> pa.RecordBatch:
        ids, ends, names = np.concatenate(self.ids), np.cumsum(np.concatenate(self.sizes)), pa.concat_arrays(self.names)
        known = names.drop_null().to_numpy().astype(np.int64)
        first = int(known[0]) if len(known) else 0
        cells = [part, segment, len(ends), len(ids), width, *EliasFano.encode(ends, len(ids)), names.null_count, first, *EliasFano.encode(known.view(np.uint64) - np.uint64(first % 2**64), (int(known[-1]) - first) if len(known) else 0), ids.tobytes()]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        fields = [x.split() for x in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(cells, fields, strict=True)], names=[n for n, _ in fields])


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` to each document, and writes segments under ``path``.

    Null texts count as empty: one id, the end. Documents stand in ascending order of an integer id, null ids first and kept
    as null; rows of the same id stand together, in order of a hash of their text. An empty table gives no segment. Other columns are ignored.
    Ids that are no integers are an error.
    """
    if documents.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_column} is no integer")
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = on_worker(_loaded, (vocabulary, end_id), lambda: Encoder(vocabulary, end_id))
        held, segment = _Segment(), 0
        for batch in by_bytes(batches, 1, TEXT_BYTES):
            ids, size = enc.ids(batch.column(1))
            ends, at, used = np.cumsum(size), 0, 0
            while at < len(ends):
                # up to the document with which the segment has enough
                stop = min(len(ends), int(np.searchsorted(ends, used + segment_ids - held.n_ids, side="left")) + 1)
                held.add(ids[used : ends[stop - 1]], size[at:stop], batch.column(0).slice(at, stop - at))
                at, used = stop, int(ends[stop - 1])
                if held.n_ids >= segment_ids:
                    yield held.row(part, segment, enc.width)
                    held, segment = _Segment(), segment + 1
        if held.n_ids:
            yield held.row(part, segment, enc.width)

    rows.mapInArrow(run, _SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in the files' order), n_tokens (with the end id), ids (binary, little-endian unsigned 32-bit) of each document."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a partition: small
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("parts_before"))
    segments = files.select("part", "segment", "n_ids").withColumn("segments_before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)))
    starts = segments.join(before, "part").select("part", "segment", (F.coalesce("parts_before", F.lit(0)) + F.coalesce("segments_before", F.lit(0))).alias("begin"))
    if files.count() <= STARTS:
        starts = F.broadcast(starts)
    docs = files.mapInArrow(_unpacked, "part int, segment int, doc_id long, offset long, n_tokens long, ids binary")
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            n, n_null = row["n_docs"], row["n_null"]
            ends = EliasFano(n, row["low_bits"], row["low"], row["high"]).select(np.arange(n)).astype(np.int64)
            begins = np.concatenate(([0], ends[:-1]))
            known = EliasFano(n - n_null, row["doc_low_bits"], row["doc_low"], row["doc_high"]).select(np.arange(n - n_null)) + np.uint64(row["first_doc"] % 2**64)
            names = pa.concat_arrays([pa.nulls(n_null, pa.int64()), pa.array(known.view(np.int64))])
            wide = np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype("<u4")
            cells = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.append(begins, ends[-1:]) * 4).astype(np.int32)), pa.py_buffer(wide)])
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), names, pa.array(begins), pa.array(ends - begins), cells], names=["part", "segment", "doc_id", "offset", "n_tokens", "ids"])
