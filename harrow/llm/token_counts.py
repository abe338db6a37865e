"""Token counts of whole texts by overlap resynchronisation.

A text of more than ``CHUNK`` bytes is encoded as overlapping chunks with offsets. Two neighbours are spliced at the boundary nearest to the middle of
their overlap that both encodings have and that the pre-splitting proves stable: no token of either side can depend on what lies beyond. Where an
overlap holds no such boundary it is widened, in the end to both chunks together. The count is that of each chunk's tokens between its splices.
A text of one chunk is encoded whole.

For a .json file whose pre-splitting ``units`` knows, boundaries are those of its units; for a sentencepiece file whose pieces hold white space at
their start only, they are the starts of words after single spaces. Any other file's texts are encoded whole by its library.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes, on_worker
from .units import Units, buffer_of, cuts_at_units, settings_of

#: Bytes of a chunk and of the overlap between two, at first.
CHUNK, OVERLAP = 4096, 256
#: Bytes of texts that are worked on at once.
TEXT_BYTES = 8 << 20
_loaded: dict = {}


@dataclass
class Encoding:
    """Of a stretch of text: stable boundaries (ascending byte offsets in the text), tokens of the stretch before each, and tokens in all."""

    places: np.ndarray
    before: np.ndarray
    total: int


def splice(left: Encoding, right: Encoding, after: int, begin: int, end: int) -> tuple[int, int, int] | None:
    """(place, tokens of left before it, tokens of right before it) of the boundary of both beyond ``after`` that is nearest to the middle of the overlap
    begin to end; None where there is none."""
    mine = left.places[np.searchsorted(left.places, max(after, begin), side="right") :]
    both = mine[np.isin(mine, right.places)]
    if not len(both):
        return None
    place = int(both[np.argmin(np.abs(both - (begin + end) // 2))])
    return place, int(left.before[np.searchsorted(left.places, place)]), int(right.before[np.searchsorted(right.places, place)])


def planned(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of a text of n bytes where every overlap can be spliced."""
    out = [(0, min(n, chunk))]
    while out[-1][1] < n:
        begin = max(out[-1][0] + 1, out[-1][1] - overlap)
        out.append((begin, min(n, begin + max(chunk, 2 * overlap))))
    return out


def spliced(encode: Callable[[int, int], Encoding], n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of n bytes; encode(begin, end) encodes a stretch of it."""
    at, end, width, after = 0, min(n, chunk), overlap, 0
    held, first, counted = encode(at, end), 0, 0
    while end < n:
        begin = max(at + 1, end - width)
        stop = min(n, begin + max(chunk, 2 * width))
        more = encode(begin, stop)
        found = splice(held, more, after, begin, end)
        if found is not None:
            after, mine, others = found
            counted += mine - first
            held, first, at, end, width = more, others, begin, stop, overlap
        elif begin > at + 1:
            width *= 2
        else:  # nothing stable in the whole chunk: it is encoded together with what follows
            end, width = min(n, at + 2 * (end - at)), overlap
            held = encode(at, end)
    return counted + held.total - first


class Counter:
    """Counts tokens with a vocabulary file of the tokenizers library (.json) or of sentencepiece (.model)."""

    def __init__(self, path: str):
        self.units = self.encoded = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            if all("\u2581" not in p.lstrip("\u2581") for p in pieces) and len(model.encode("a")) == len(model.encode(" a")):
                self.encoded = lambda text, begin: _sentencepiece_encoding(model, text, begin)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        encode = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        self.many = lambda texts: list(map(len, encode(texts)))
        if cuts_at_units(settings_of(tok)) and len(encode(["\n"])[0]) == 1:
            self.units = Units(encode, "\n")

    def counts(self, column: pa.Array, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Of each text of a column without nulls."""
        buf, offsets = buffer_of(column)
        size = np.diff(offsets)
        if self.units is None:
            out = np.zeros(len(column), dtype=np.int64)
            long = np.flatnonzero(size > chunk) if self.encoded else np.zeros(0, dtype=np.int64)
            short = np.setdiff1d(np.arange(len(column)), long)
            out[short] = self.many(column.take(pa.array(short)).to_pylist())
            for k in long.tolist():
                out[k] = self._long(buf[offsets[k] : offsets[k + 1]], {}, chunk, overlap)
            return out
        # chunks of all texts, one after another, are cut into units and counted at once
        rows = [[(0, int(n))] if n <= chunk else [(_aligned(buf, o, b, n), _aligned(buf, o, e, n)) for b, e in planned(int(n), chunk, overlap)] for o, n in zip(offsets[:-1].tolist(), size.tolist(), strict=True)]
        begin = np.array([o + b for o, r in zip(offsets[:-1].tolist(), rows, strict=True) for b, _ in r], dtype=np.int64)
        end = np.array([o + e for o, r in zip(offsets[:-1].tolist(), rows, strict=True) for _, e in r], dtype=np.int64)
        if len(begin) > len(column):
            joined = np.concatenate([buf[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
        else:
            joined = buf
        edges = np.concatenate(([0], np.cumsum(end - begin)))
        starts, unit = self.units.of(joined, edges[:-1][end > begin])
        before = np.concatenate(([0], np.cumsum(self.units.size[unit])))
        at = np.searchsorted(starts, edges)
        whole = np.diff(before[at])
        out = np.zeros(len(column), dtype=np.int64)
        row = 0
        for k, r in enumerate(rows):
            if len(r) == 1:
                out[k] = whole[row]
            else:
                known = {}
                for i, (b, e) in enumerate(r, row):
                    own = slice(at[i] + 1, at[i + 1])  # a chunk's own start is no boundary: what stands before it isn't seen
                    known[b, e] = Encoding(starts[own] - edges[i] + b, before[own] - before[at[i]], int(whole[i]))
                out[k] = self._long(buf[offsets[k] : offsets[k + 1]], known, chunk, overlap)
            row += len(r)
        return out

    def _long(self, text: np.ndarray, known: dict[tuple[int, int], Encoding], chunk: int, overlap: int) -> int:
        n = len(text)

        def encode(begin: int, end: int) -> Encoding:
            span = _aligned(text, 0, begin, n), _aligned(text, 0, end, n)
            if span not in known:
                known[span] = self._encoding(text[span[0] : span[1]], span[0])
            return known[span]

        return spliced(encode, n, chunk, overlap)

    def _encoding(self, text: np.ndarray, begin: int) -> Encoding:
        if self.units is None:
            return self.encoded(text.tobytes().decode(), begin)
        starts, unit = self.units.of(text, np.zeros(1, dtype=np.int64))
        before = np.cumsum(self.units.size[unit]) - self.units.size[unit]
        return Encoding(starts[1:] + begin, before[1:], int(self.units.size[unit].sum()))


def _aligned(buf: np.ndarray, origin: int, place: int, n: int) -> int:
    """``place`` moved on to the start of a character of the text of n bytes at ``origin``."""
    while place < n and buf[origin + place] & 0xC0 == 0x80:
        place += 1
    return place


def _sentencepiece_encoding(model, text: str, begin: int) -> Encoding:
    """Boundaries before single spaces that stand between two ASCII letters or digits and begin a piece."""
    found = model.encode(text, out_type="immutable_proto").pieces
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    plain = np.zeros(256, dtype=bool)
    plain[48:58] = plain[65:91] = plain[97:123] = True
    stable = np.flatnonzero(plain[raw[:-2]] & (raw[1:-1] == 32) & plain[raw[2:]]) + 1
    byte = np.cumsum([0, *(len(c.encode()) for c in text)]) if not text.isascii() else None
    at = np.array([p.begin for p in found], dtype=np.int64)
    at = at if byte is None else byte[at]
    stable = stable[np.isin(stable, at)]
    return Encoding(stable + begin, np.searchsorted(at, stable), len(found))


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``path`` is the vocabulary's place on every executor. Null counts as empty (0 bytes, 0 tokens). One row comes out
    for each row that goes in, in no order; null ids and repeated rows stay; other columns are ignored. An empty table gives an empty result.
    Special strings inside texts are handled as the library does by default.
    """
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_column].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = on_worker(_loaded, path, lambda: Counter(path))
        for batch in by_bytes(batches, 2, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.counts(batch.column(2), chunk, overlap))], names=schema.names)

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
