"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of consecutive rows of a partition. Its words become a sequence over the benchmark's vocabulary; any other word,
and every end of a document, is a separator that is distinct from all others. The shard's suffix array
(prefix doubling) gives the Burrows-Wheeler transform, kept as a wavelet matrix with rank counts. All
benchmark windows are searched backwards at once; the ranges that survive are located by walking to sampled
suffix positions, and occurrences are merged into removal spans.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes, written
from .textbytes import words_of

#: Words in a window, bytes of text in a shard, and every how many text positions one is sampled.
WINDOW_WORDS, SHARD_BYTES, SAMPLE = 13, 2 << 20, 16
#: Words of one index: a longer text is indexed in stretches that overlap by a window less a word.
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text that are held in one set of patterns; a larger benchmark is searched in several sets.
PATTERN_BYTES = 32 << 20


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t``, whose zeros are separators: all distinct, ordered by position, below all else. ``t`` ends with 0."""
    n = len(t)
    rank = np.empty(n, dtype=np.int64)
    ends = np.flatnonzero(t == 0)
    rank[ends] = np.arange(len(ends))
    counts = np.bincount(t)
    counts[0] = len(ends)
    begin = np.cumsum(counts) - counts
    rest = np.flatnonzero(t)
    rank[rest] = begin[t[rest]]
    active, h = rest[counts[t[rest]] > 1], 1
    while len(active):
        key = rank[active] * n + rank[active + h]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        index = np.arange(len(active))
        group = np.maximum.accumulate(np.where(new_old, index, 0))
        first = np.maximum.accumulate(np.where(new_key, index, 0))
        rank[active] = old + first - group
        alone = new_key & np.concatenate((new_key[1:], [True]))
        active, h = active[~alone], 2 * h
    sa = np.empty(n, dtype=np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return sa


class FMIndex:
    """Counts and locates words sequences in ``t`` (symbols 1..sigma-1; 0 separates and cannot be searched)."""

    def __init__(self, t: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(t)
        bwt = t[sa - 1]  # row of suffix 0: the last symbol, a separator
        self.bwt = bwt.astype(np.int32)
        counts = np.bincount(t, minlength=sigma)
        self.begin = np.concatenate(([0], np.cumsum(counts)))
        kept = (bwt == 0) | (sa % sample == 0)
        self.kept, self.kept_before, self.position = kept, np.cumsum(kept, dtype=np.int32) - kept, sa[kept]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.bwt
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            before = np.zeros(len(row) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:], dtype=np.int32)
            zeros = len(row) - int(before[-1])
            self.levels.append((bit, before, zeros))
            row = np.concatenate((row[ones == 0], row[ones == 1]))
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, before, zeros in self.levels:
            ones = before[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First row of ``symbol`` plus its rank before row ``at``."""
        return self.begin[symbol] + self._down(symbol, at) - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns that occur; row p of ``patterns`` is right-aligned."""
        width = patterns.shape[1]
        alive = np.arange(len(patterns))
        last = patterns[:, -1]
        low, high = self.begin[last], self.begin[last + 1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(1, width + 1):
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            done = lengths[alive] == step
            if done.any():
                found.append((alive[done], low[done], high[done]))
                alive, low, high = alive[~done], low[~done], high[~done]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - step]
            low, high = self.extend(symbol, low), self.extend(symbol, high)
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        out, steps, at, which = np.empty(len(rows), dtype=np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(which):
            hit = self.kept[at]
            out[which[hit]] = self.position[self.kept_before[at[hit]]] + steps
            which, at = which[~hit], at[~hit]
            at = self.extend(self.bwt[at], at)
            steps += 1
        return out


class Patterns:
    """The distinct windows of benchmark items as symbol rows, and the items of each window."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW_WORDS):
        doc, _, _, h = words_of([t for _, t in items])
        count = np.bincount(doc, minlength=len(items)) if len(items) else np.zeros(0, dtype=np.int64)
        first = np.cumsum(count) - count
        self.vocabulary = np.unique(h)
        symbol = np.searchsorted(self.vocabulary, h) + 1
        runs = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        of = np.repeat(np.arange(len(items)), runs)
        at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
        length = np.minimum(count[of], window)
        # windows as rows of symbols, right-aligned; shorter ones begin with zeros
        rows = np.zeros((len(of), window), dtype=np.int32)
        for k in range(window):
            inside = k >= window - length
            rows[inside, k] = symbol[(at + k - (window - length))[inside]]
        self.symbols, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.ravel()
        self.lengths = (self.symbols > 0).sum(axis=1)
        pairs = np.unique(which * max(1, len(items)) + of)
        which, self.owners = np.divmod(pairs, max(1, len(items)))
        self.owner_count = np.bincount(which, minlength=len(self.symbols))
        self.owner_first = np.cumsum(self.owner_count) - self.owner_count
        self.items = [None if i is None else str(i) for i, _ in items]


def _occurrences(symbol: np.ndarray, doc: np.ndarray, origin: int, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, word where it begins) of the occurrences in a stretch of words, by an index of the stretch."""
    place = np.arange(len(symbol)) + doc - doc[0]  # each text is followed by one separator
    t = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    t[place] = symbol
    index = FMIndex(t, len(p.vocabulary) + 1)
    which, low, high = index.search(p.symbols, p.lengths)
    many = high - low
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.repeat(which, many), np.searchsorted(place, index.locate(rows)) + origin


def scan_shard(texts: list[bytes | None], p: Patterns) -> list[tuple[int, int, list[int], list[str], list[int]]]:
    """For each text: words, hit words, word spans (start, end, ...), items, byte spans (start, end, ...)."""
    doc, start, end, h = words_of(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    out = [(int(n), 0, [], [], []) for n in n_words]
    if not len(h) or not len(p.vocabulary):
        return out
    at = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[at] == h, at + 1, 0)
    width = p.symbols.shape[1]
    parts = [_occurrences(symbol[k : k + SHARD_WORDS + width - 1], doc[k : k + SHARD_WORDS + width - 1], k, p) for k in range(0, len(h), SHARD_WORDS)]
    pattern, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(pattern):
        return out
    length = p.lengths[pattern]
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + length, -1)
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(doc[hit], minlength=len(texts))
    pairs = p.owner_count[pattern]
    owner = p.owners[np.repeat(p.owner_first[pattern] - (np.cumsum(pairs) - pairs), pairs) + np.arange(pairs.sum())]
    found = np.unique(np.repeat(doc[begin], pairs) * max(1, len(p.items)) + owner)
    items: dict[int, list[str | None]] = {}
    for x in found:
        items.setdefault(int(x // len(p.items)), []).append(p.items[x % len(p.items)])
    first = np.cumsum(n_words) - n_words
    for d, names in items.items():
        own = hit[first[d] : first[d] + n_words[d]]
        edge = np.flatnonzero(np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        spans = edge.reshape(-1, 2)
        places = np.column_stack((start[first[d] + spans[:, 0]], end[first[d] + spans[:, 1] - 1])).ravel()
        out[d] = (int(n_words[d]), int(n_hit[d]), edge.tolist(), sorted(set(names), key=lambda x: (x is None, x or "")), places.tolist())
    return out


def _scan(documents: DataFrame, patterns: Patterns, id_column: str, text_column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(patterns)
    kept = [documents.schema[c] for c in keep]
    found = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("word_spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("byte_spans", T.ArrayType(T.LongType()))]
    own = T.StructType([T.StructField("doc_id", documents.schema[id_column].dataType), *kept])
    schema = T.StructType([*own.fields, *found])
    width = len(own.fields)
    at = 1 + keep.index(text_column) if text_column in keep else width  # a kept text is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        slices: list[pa.RecordBatch] = []
        texts: list[bytes | None] = []

        def done() -> pa.RecordBatch:
            rows = scan_shard(texts, p)
            cols = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)]
            first = [pa.concat_arrays([s.column(k) for s in slices]) for k in range(width)]
            return pa.RecordBatch.from_arrays([*first, *cols], names=schema.names)

        size = 0
        for batch in by_bytes(batches, at, SHARD_BYTES):
            values, begin = batch.column(at).cast(pa.binary()).to_pylist(), 0
            for i, v in enumerate(values):
                size += len(v or b"")
                texts.append(v)
                if size >= SHARD_BYTES:
                    slices.append(batch.slice(begin, i + 1 - begin))
                    yield done()
                    slices, texts, begin, size = [], [], i + 1, 0
            if begin < len(values):
                slices.append(batch.slice(begin))
        if texts:
            yield done()

    return documents.select(F.col(id_column).alias("doc_id"), *[F.col(c) for c in keep], *([F.col(text_column).alias("_text")] if at == width else [])).mapInArrow(run, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """doc_id, the ``keep`` columns, n_words, n_hit, word_spans, items, byte_spans: which words of each document lie inside a benchmark window.

    Spans are flat lists of starts and ends: words, and bytes of the UTF-8 text. Null and wordless texts have no
    words, spans or items; null and wordless items have no windows. One row comes out for each row that goes in,
    repeated rows and null ids included; other columns of the input are ignored, and a kept column may have any name but doc_id. An empty table gives an
    empty result. An item without an id counts as one, and stands in ``items`` as null.
    The benchmark's size is measured first: patterns are broadcast in sets of at most ``pattern_bytes`` bytes of item text (a
    single longer item is a set of its own), and the sets' spans are merged.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sets = max(1, -(-int(total) // pattern_bytes))
    if sets == 1:
        return _scan(documents, Patterns(_collected(items)), id_column, text_column, keep)
    marked = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(c) for c in keep if c not in ("_row", "_id", "_text")])
    marked = written(marked, "documents")
    # one set at a time: its patterns are in memory only while it is searched
    parts = [written(_scan(marked, Patterns(_collected(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(sets)) == s))), "_row", "_text"), "spans") for s in range(sets)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    merged = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list(_pairs("word_spans"))).alias("w"), F.flatten(F.collect_list(_pairs("byte_spans"))).alias("b"))
    merged = merged.select(F.col("doc_id").alias("_row"), "n_words", "items", _union("w").alias("word_spans"), _union("b").alias("byte_spans"))
    length = F.aggregate(F.sequence(F.lit(0), F.size("word_spans") - 1), F.lit(0).cast("long"), lambda s, i: s + F.when(i % 2 == 1, F.element_at("word_spans", i + 1)).otherwise(-F.element_at("word_spans", i + 1)))
    merged = merged.withColumn("n_hit", F.when(F.size("word_spans") > 0, length).otherwise(F.lit(0)).cast("long"))
    return marked.select("_row", F.col("_id").alias("doc_id"), *keep).join(merged, "_row").select("doc_id", *keep, "n_words", "n_hit", "word_spans", "items", "byte_spans")


def _pairs(c: str):
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), (F.size(c) / 2 - 1).cast("int")), lambda i: F.struct(F.element_at(c, (2 * i + 1).cast("int")).alias("s"), F.element_at(c, (2 * i + 2).cast("int")).alias("e")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def _union(c: str):
    """Sorted disjoint union of spans as a flat list. Spans of bytes join across sets only where they touch or overlap."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(F.array_sort(c), start, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, F.lit(-1)) >= x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, F.lit(-1)), x["e"])))).otherwise(F.concat(acc, F.array(x["s"], x["e"]))))


def _collected(items: DataFrame) -> list[tuple[str, bytes]]:
    """Of a set whose size was measured."""
    return [(r.item, bytes(r.text)) for r in items.collect()]


def contamination_report(found: DataFrame) -> DataFrame:
    """The report of a scan: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_spans(text: bytes, byte_spans: list[int]) -> bytes:
    """``text`` without the bytes inside the spans."""
    out, at = [], 0
    for s, e in zip(byte_spans[::2], byte_spans[1::2], strict=True):
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])




