"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The counts of rows that go from each input file to each shard are drawn exactly (multivariate hypergeometric), so the
shards' sizes are fixed in advance and every arrangement stays equally likely. Rows are permuted within their
file (a keyed bijection of their places), dealt to shards by the drawn counts, exchanged once, and permuted again within
their shard, bucket by bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows, and bytes of strings and binaries, of a bucket of a shard, about.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 16 << 20
#: Cells of the matrix, and buckets, that are broadcast (16 and 24 bytes each); beyond that they are joined by a shuffle.
MATRIX_CELLS, BROADCAST_BUCKETS = 4_000_000, 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement from good + bad are good; exact at any size.

    The library's sampler takes fewer than 10**9 of each kind; larger cases are split: the first draws are made
    from halves of the population, whose own share is drawn the same way by inversion from the mode outwards.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good + bad else 0
    from math import lgamma

    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    weight = np.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    left = rng.random() - weight
    up = down = mode
    p_up = p_down = weight
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) / (up + 1) * (n - up) / (bad - n + up + 1)
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down / (good - down + 1) * (bad - n + down) / (n - down + 1)
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows from each partition (axis 0) to each shard (axis 1): row sums are ``counts``, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = int(counts.sum())
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        n, rest = int(n), int(left.sum())
        if rest < 10**9:
            out[p] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        else:
            for s in range(shards):
                rest -= int(left[s])
                out[p, s] = hypergeometric(rng, int(left[s]), rest, n) if n else 0
                n -= int(out[p, s])
        left -= out[p]
    return out


def permuted(place: Column, n: Column, key: Column, rounds: int = 24) -> Column:
    """A keyed bijection of 0..n-1 by ``rounds`` swap-or-not steps: each pairs x with pivot - x (mod n) and swaps the two or not."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        bit = F.xxhash64(key, -r - 1, F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.transform(F.array(F.struct(partner.alias("p"), bit.alias("b"))), lambda y: F.when(y["b"] == 1, y["p"]).otherwise(x))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), place.cast("long"), step)


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 7, stable: bool = False) -> DataFrame:
    """``documents`` with columns ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within a shard).

    Shards' row counts differ by one at most. ``stable``: the caller states that ``documents`` is a plain scan of Parquet files; any
    other input, or a scan that leaves out rows, is first written to the shared folder. A row's part and place are its file and its
    index there, so both passes agree however Spark splits the files. All rows are kept: repeated rows, nulls and
    empty texts are rows like others. Columns of the input named shard or slot are replaced; the result for an empty table is
    empty. The same seed and the same files give the same result.
    """
    spark = documents.sparkSession
    documents = documents.drop("shard", "slot")
    if not stable:
        documents = written(documents, "unsharded")
    own = documents.columns
    placed = documents.withColumns({"_file": F.col("_metadata.file_path"), "_place": F.col("_metadata.row_index")})
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in documents.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.sum(sum(wide, F.lit(0).cast("long"))).alias("size")
    found = sorted((r._file, r.n, r.last, r.size) for r in placed.groupBy("_file").agg(F.count("*").alias("n"), F.max("_place").alias("last"), size).collect())  # a row a file
    if stable and any(last + 1 != n for _, n, last, _ in found):
        return shard_documents(documents, shards, seed)
    if not found:
        return documents.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    counts = np.array([n for _, n, _, _ in found], dtype=np.int64)
    ends = communication_matrix(counts, shards, seed).cumsum(axis=1)
    rows = [(f, p, n, [int(x) for x in e]) for p, ((f, n, _, _), e) in enumerate(zip(found, ends, strict=True))]
    matrix = spark.createDataFrame(rows, "_file string, _part int, _n long, _ends array<long>")
    matrix = F.broadcast(matrix) if ends.size <= MATRIX_CELLS else matrix

    x = permuted(F.col("_place"), F.col("_n"), F.xxhash64(F.lit(seed), F.col("_part")))
    total, weight = int(counts.sum()), sum(x[3] for x in found)
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)), -(-weight // (shards * BUCKET_BYTES)))

    def dealt(rows: DataFrame) -> DataFrame:
        # the place is bound once: as a column of its own it would be worked out again for each element of _ends
        shard = F.transform(F.array(x), lambda y: F.size(F.filter("_ends", lambda e: e <= y)))[0]
        rows = rows.join(matrix, "_file").withColumn("shard", shard.cast("int"))
        rows = rows.withColumn("_key", F.xxhash64(F.lit(seed + 1), F.col("_part"), F.col("_place")))
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_key")), F.lit(buckets)).cast("int"))

    sizes = dealt(placed.select("_file", "_place")).groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))  # a row a bucket
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "_bucket", "_first")
    order = Window.partitionBy("shard", "_bucket").orderBy("_key", "_part", "_place")
    out = dealt(placed).withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(first) if shards * buckets <= BROADCAST_BUCKETS else first, ["shard", "_bucket"])
    return out.select(*own, "shard", (F.col("_first") + F.col("_rank")).cast("long").alias("slot"))


def write_shards(documents: DataFrame, path: str, shards: int = 24, seed: int = 7, stable: bool = False) -> None:
    """Writes the shuffle as one folder a shard, rows of each file ascending by slot."""
    shard_documents(documents, shards, seed, stable).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


