"""Near-duplicate documents by ProbMinHash.

1. A text's runs of five words, weighted 1 + ln(count), send points of a Poisson process whose rate is the weight to
   ``bands * rows`` registers; each register keeps its earliest arrival and the shingle that sent it, and a shingle stops as soon as
   its next arrival is later than every register's. Two texts agree in a register with the probability Jaccard
   similarity of their weights (plain Jaccard where every shingle occurs once).
2. Texts with the same words are one class from the start. Classes that agree in all registers of a band share a bucket.
   Buckets with the same members count once.
3. Verification, on the exact similarity: each bucket's members against its first member (stars), then connected components; buckets
   that still hold several components are compared in full, in tiles of bounded size, skipping what is connected.
   No pair of candidates is a row of its own, and no bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import by_bytes, spread_join, written
from .textbytes import chunks, mix, shingles_of, words_of

#: Words in a shingle, least similarity, bands of registers, registers in a band, members in a tile.
SHINGLE, THRESHOLD, BANDS, ROWS, TILE = 5, 0.8, 32, 8, 512
#: Shingles of a block (8 to 12 bytes each).
TILE_SHINGLES = 1 << 20
#: Ids that may be broadcast (about 40 bytes each); beyond that a shuffle is used.
BROADCAST_IDS = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prob_min_hash(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs x k) of weighted elements: in each register the element that arrives first, 0 where a text has none.

    Waves: the first arrivals of all elements, then the next of those that could still win somewhere.
    """
    time = np.full(n_docs * k, np.inf)
    winner = np.zeros(n_docs * k, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)
    t = np.zeros(len(h))
    wave = 0
    while len(h):
        wave += 1
        x = mix(h + np.uint64(wave * int(_GOLD) % 2**64))
        t = t - np.log1p(-((x >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / w
        early = t < latest[doc]
        if not early.all():
            doc, h, w, t, x = doc[early], h[early], w[early], t[early], x[early]
            if not len(h):
                break
        at = doc * k + (mix(x) % np.uint64(k)).astype(np.int64)
        better = t < time[at]
        np.minimum.at(time, at[better], t[better])
        won = better & (time[at] == t)
        winner[at[won]] = h[won]
        touched = np.unique(doc[won])
        latest[touched] = time.reshape(n_docs, k)[touched].max(axis=1)
    return winner.reshape(n_docs, k)


def weighted_shingles(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text index, shingle, weight) with the shingles of a text distinct and ascending; and a 16-byte key of each text's words."""
    doc, _, _, h = words_of(texts)
    count = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(count)
    raw = h.tobytes()
    keys = [hashlib.blake2b(raw[8 * (e - n) : 8 * e] if n else texts[i] or b"", digest_size=16, person=b"words" if n else b"bytes").digest() for i, (n, e) in enumerate(zip(count, end, strict=True))]
    of, s = shingles_of(doc, h, len(texts), width)
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return of[first], s[first], 1 + np.log(np.diff(np.append(first, len(s)))), keys


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The sum over common elements i of 1 / sum_j max(wa_j / wa_i, wb_j / wb_i); a and b are ascending."""
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = wa
    y[np.searchsorted(every, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    both = (x > 0) & (y > 0)
    at = np.searchsorted(ratio, ratio[both], side="left")
    below = np.concatenate(([0.0], np.cumsum(y)))[at]
    above = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))[at]
    return float(np.sum(1 / (above / x[both] + below / y[both])))


class Member:
    __slots__ = ("key", "component", "shingles", "weights", "total")

    def __init__(self, key: bytes, component: bytes, shingles: bytes, weights: bytes):
        self.key, self.component = key, component
        self.shingles = np.frombuffer(shingles, dtype="<u8")
        self.weights = np.frombuffer(weights, dtype="<f4").astype(np.float64) if weights else None
        self.total = float(len(self.shingles)) if self.weights is None else float(self.weights.sum())

    def similar(self, other: Member, common: int, threshold: float) -> bool:
        """``common``: how many shingles they share."""
        if self.weights is None and other.weights is None:
            return common >= (threshold - 1e-9) * (len(self.shingles) + len(other.shingles) - common)
        ones = np.ones
        wa = ones(len(self.shingles)) if self.weights is None else self.weights
        wb = ones(len(other.shingles)) if other.weights is None else other.weights
        # no element adds more than its share of either side
        if min(wa[np.isin(self.shingles, other.shingles)].sum() / self.total, wb[np.isin(other.shingles, self.shingles)].sum() / other.total) < threshold - 1e-9:
            return False
        return probability_jaccard(self.shingles, wa, other.shingles, wb) >= threshold - 1e-9


def common_counts(members: list[Member]) -> np.ndarray:
    """How many shingles each two members share, by products of blocks of columns that hold shared shingles only."""
    m = len(members)
    out = np.zeros((m, m), dtype=np.float32)
    value = np.concatenate([x.shingles for x in members])
    owner = np.repeat(np.arange(m), [len(x.shingles) for x in members])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(value)))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)
    owner, column = owner[shared], column[shared]
    step = 2048
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + step, step))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        x = np.zeros((m, step), dtype=np.float32)
        x[owner[a:b], column[a:b] - k * step] = 1
        out += x @ x.T
    return out


def star_links(hub: Member, members: list[Member], threshold: float) -> list[tuple[bytes, bytes]]:
    value = np.concatenate([x.shingles for x in members])
    at = np.minimum(np.searchsorted(hub.shingles, value), len(hub.shingles) - 1)
    total = np.concatenate(([0], np.cumsum(hub.shingles[at] == value)))
    end = np.cumsum([len(x.shingles) for x in members])
    common = np.diff(total[np.concatenate(([0], end))])
    return [(hub.key, x.key) for x, n in zip(members, common, strict=True) if hub.similar(x, int(n), threshold)]


def tile_links(left: list[Member], right: list[Member], threshold: float) -> list[tuple[bytes, bytes]]:
    """Pairs of components that a pair of similar members joins: enough of them to connect all that are so joined.
    Within ``left`` if ``right`` is empty, else between the two."""
    members = left + right
    common = common_counts(members)
    size = np.array([len(x.shingles) for x in members], dtype=np.float32)
    root = {x.component: x.component for x in members}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    # a shingle weighs 1 + ln(count) >= 1; where neither side repeats any, the bound below is the similarity itself
    plain = np.array([x.weights is None for x in members])
    possible = common >= (threshold - 1e-6) * (size[:, None] + size[None, :] - common)
    possible |= ~(plain[:, None] & plain[None, :]) & (common > 0)
    a, b = np.nonzero(np.triu(possible, 1))
    if right:
        across = (a < len(left)) & (b >= len(left))
        a, b = a[across], b[across]
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(members[i].component), find(members[j].component)
        if x != y and members[i].similar(members[j], int(common[i, j]), threshold):
            root[max(x, y)] = min(x, y)
            out.append((members[i].component, members[j].component))
    return out


def _signed(documents: DataFrame, id_column: str, text_column: str, shingle: int, bands: int, rows: int) -> DataFrame:
    kind = documents.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            texts = batch.column(1).to_pylist()
            keys: list[bytes | None] = []
            buckets: list[np.ndarray | None] = []
            for a, b in chunks(texts):
                of, s, w, k = weighted_shingles(texts[a:b], shingle)
                keys += [None if t is None else x for t, x in zip(texts[a:b], k, strict=True)]
                sig = prob_min_hash(of, s, w, b - a, bands * rows).reshape(b - a, bands, rows)
                h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (b - a, bands))
                for r in range(rows):
                    h = mix(h * _GOLD + sig[:, :, r])
                some = np.bincount(of, minlength=b - a) > 0
                buckets += [x if y else x[:0] for x, y in zip(h.view(np.int64), some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=schema.names)

    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(run, schema)


def _shingled(rows: DataFrame, shingle: int) -> DataFrame:
    """key, shingles, weights (empty: all 1) of rows (key, text) whose text has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                of, s, w, own = weighted_shingles(texts[a:b], shingle)
                edge = np.searchsorted(of, np.arange(b - a + 1))
                good = [i for i in range(b - a) if own[i] == keys[a + i]]
                cells = [(keys[a + i], s[edge[i] : edge[i + 1]].astype("<u8").tobytes(), w[edge[i] : edge[i + 1]].astype("<f4").tobytes() if (w[edge[i] : edge[i + 1]] > 1).any() else b"") for i in good]
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*cells, strict=True)], names=["key", "shingles", "weights"])

    return rows.mapInArrow(run, "key binary, shingles binary, weights binary").dropDuplicates(["key"])


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``width`` cells; a run is of bounded size."""
    name, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != name:
                if held:
                    yield name, held
                name, held = row[:width], []
            held.append(row[width:])
    if held:
        yield name, held


def _links(found: Iterator[list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
    for links in found:
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links, strict=True)], names=["a", "b"])


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """doc_id, class_id, kept: one row for each row of ``documents``; class_id is the smallest id of the rows whose texts are linked.

    Texts are linked if their words are the same, or if they share a bucket and their similarity is ``threshold`` or more; classes are
    the connected components. A text of fewer than ``shingle`` words is one shingle. Wordless and empty texts are linked with equal texts only;
    null texts with nothing (their class is their own id). ``kept``: doc_id = class_id. Rows of one id with different texts may fall into several
    classes; null ids don't name a class unless all ids of a class are null. Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    signed = written(_signed(documents, id_column, text_column, shingle, bands, rows), "signed")
    texts = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("buckets").alias("buckets"))
    held = texts.select("key", "doc_id", F.explode("buckets").alias("bucket"))
    # of a bucket's members: how many, the one with the smallest hash, and two digests that tell sets apart; fixed-width numbers only, so that hashing suffices
    mark = F.xxhash64("key")
    sets = held.select("bucket", mark.alias("h"), F.xxhash64(F.lit(1), "key").alias("g")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("h").alias("hub"), F.bit_xor("h").alias("s"), F.bit_xor("g").alias("t")).where("n > 1")
    sets = sets.groupBy("n", "hub", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "hub")
    members = written(held.join(sets, "bucket"), "members")
    needed = written(members.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "needed")
    n_needed = needed.count()
    if not n_needed:
        return _classes(signed, None)
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text")).where("text is not null")
    wanted = needed.withColumnRenamed("doc_id", "_id")
    wanted = F.broadcast(wanted) if n_needed <= BROADCAST_IDS else wanted
    shingles = written(_shingled(source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text"), shingle), "shingles")

    sizes = shingles.select("key", (F.octet_length("shingles") / 8).cast("long").alias("size"))
    members = written(spread_join(members, sizes, "key", "inner"), "sized")
    # blocks of a bucket are bounded by members and by shingles
    parts = lambda n, size: F.greatest(F.ceil(n / tile), F.ceil(size / TILE_SHINGLES), F.lit(1)).cast("int")
    buckets = members.groupBy("bucket").agg(parts(F.count("*"), F.sum("size")).alias("blocks"))
    placed = spread_join(members, written(buckets, "buckets"), "bucket", "inner")
    plain = placed.where(mark != F.col("hub")).select("bucket", F.pmod(F.xxhash64("key", "bucket"), "blocks").cast("int").alias("block"), F.lit(1).alias("rank"), "key").join(shingles, "key")
    # a hub gets its shingles before it is copied to the blocks
    hubs = placed.where(mark == F.col("hub")).join(shingles, "key").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("rank"), "key", "shingles", "weights")
    star = plain.unionByName(hubs).select("bucket", "block", "rank", "key", "shingles", "weights").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "rank")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for _, group in _grouped(batches, 2):
                if group[0][0] == 0 and len(group) > 1:
                    all_of = [Member(k, k, s, w) for _, k, s, w in group]
                    yield star_links(all_of[0], all_of[1:], threshold)

        yield from _links(each())

    first = connected_components(star.mapInArrow(stars, "a binary, b binary"))
    joined = spread_join(members.where("n > 2"), first.withColumnRenamed("vertex", "key"), "key").select("bucket", "key", "size", F.coalesce("root", "key").alias("component"))
    joined = written(joined, "joined")
    open_ = joined.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    left = written(spread_join(joined, written(open_, "open"), "bucket", "inner"), "left")
    # a component that fills a tile has blocks of its own, and those of one component are not compared with each other; smaller ones share blocks
    per = left.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    large = (F.col("n") * 2 > tile) | (F.col("size") * 2 > TILE_SHINGLES)
    alone = per.where(large).select("bucket", "component", parts(F.col("n"), F.col("size")).alias("blocks"))
    pooled = per.where(~large).groupBy("bucket").agg(parts(F.sum("n"), F.sum("size")).alias("blocks"))
    slots = written(alone.unionByName(pooled.withColumn("component", F.lit(None).cast("binary")), allowMissingColumns=True).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "slots")
    slots = slots.withColumn("id", F.xxhash64("bucket", "component", "slot"))
    pairs = slots.select("bucket", F.col("id").alias("p"), F.col("component").alias("c")).join(slots.select("bucket", F.col("id").alias("q"), F.col("component").alias("d")), "bucket").where("p <= q and not coalesce(c = d, false)").select("bucket", "p", "q")
    pairs = written(pairs, "pairs")
    own = left.join(alone.withColumnRenamed("blocks", "_n"), ["bucket", "component"], "left").join(pooled, "bucket", "left")
    slot = F.pmod(F.xxhash64("key", "bucket"), F.coalesce("_n", "blocks")).cast("int")
    own = own.select("bucket", "key", "component", F.xxhash64("bucket", F.when(F.col("_n").isNotNull(), F.col("component")), slot).alias("own")).join(shingles, "key")
    either = pairs.select("bucket", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("own"))
    tiles = own.join(either, ["bucket", "own"]).select("bucket", "p", "q", "own", "key", "component", "shingles", "weights").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (_, p, q), group in _grouped(batches, 3):
                one = [Member(*x[1:]) for x in group if x[0] == p]
                two = [Member(*x[1:]) for x in group if x[0] != p] if p != q else []
                if len({x.component for x in one + two}) > 1 and (p == q or one and two):
                    yield tile_links(one, two, threshold)

        yield from _links(each())

    second = connected_components(tiles.mapInArrow(full, "a binary, b binary"))
    # a component of the first round that the second did not join keeps its name
    roots = second.withColumnRenamed("vertex", "v").withColumnRenamed("root", "r")
    labels = first.join(roots, F.col("root") == F.col("v"), "left").select(F.col("vertex").alias("key"), F.coalesce("r", "root").alias("root"))
    alone = roots.join(first, F.col("v") == F.col("vertex"), "left_anti").select(F.col("v").alias("key"), F.col("r").alias("root"))
    return _classes(signed, written(labels.unionByName(alone), "labels"))


def _classes(signed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """labels: key, root of the keys that are linked with others."""
    smallest = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    if labels is not None:
        named = written(smallest.join(labels, "key"), "named")
        of_root = written(named.groupBy("root").agg(F.min("least").alias("of_root")), "roots")
        moved = spread_join(named.select("root", "key"), of_root, "root", "inner").select("key", "of_root")
        smallest = smallest.join(moved, "key", "left").select("key", F.coalesce("of_root", "least").alias("least"), (F.col("n") > 1).alias("copied"), F.col("of_root").isNotNull().alias("moved"))
    else:
        smallest = smallest.select("key", "least", (F.col("n") > 1).alias("copied"), F.lit(False).alias("moved"))
    # only rows of texts that occur again or are linked are looked up
    changed = written(smallest.where("copied or moved").select("key", "least"), "changed")
    out = spread_join(signed.select("doc_id", "key"), changed, "key")
    return out.select("doc_id", F.coalesce("least", "doc_id").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
