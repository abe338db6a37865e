"""Vectors as ARRAY<FLOAT>: distances in double, arithmetic, exact top k, and a quantized first stage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch


def _same(a: Column, b: Column, value: Column) -> Column:
    differ = F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), differ).otherwise(value)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def inner_product(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(_zip(a, b, lambda x, y: x * y)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(_zip(a, b, lambda x, y: F.abs(x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine kept within -1 to 1; NaN where a norm is zero."""
    both = norm(a) * norm(b)
    return _same(a, b, F.when(both > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(inner_product(a, b), both)))).otherwise(F.lit(float("nan"))))


def _finite(values: Column) -> Column:
    good = F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(values.isNull(), F.lit(None)).when(good, values).otherwise(F.raise_error(F.lit("a vector's component is not finite")))


def _elementwise(a: Column, b: Column, f) -> Column:
    return _same(a, b, _finite(F.zip_with(a, b, lambda x, y: f(x, y).cast("float"))))


def add(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x * y)


def normalize(a: Column) -> Column:
    """A unit vector; null for zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: F.try_divide(x.cast("double"), n).cast("float")))


def dims(a: Column) -> Column:
    return F.size(a)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by components, and a vector that begins another comes first; null if either is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a < b, -1).when(a > b, 1).otherwise(0)


def to_vector(a: Column, n: int | None = None) -> Column:
    """An array of floats with no null or non-finite component, of n components if given."""
    v = _finite(F.transform(a, lambda x: F.when(x.isNull(), F.raise_error(F.lit("a vector's component is null"))).otherwise(x.cast("float"))))
    return v if n is None else F.when(a.isNull() | (F.size(a) == n), v).otherwise(F.raise_error(F.lit(f"expected {n} dimensions")))


def vector_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    """From ``[1,2,3]``: anything else is an error."""
    shape = r"^\s*\[\s*[^,\s\[\]]+\s*(,\s*[^,\s\[\]]+\s*)*\]\s*$"
    inner = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.when(text.rlike(shape), to_vector(F.transform(F.split(inner, ","), lambda x: x.cast("float")))).when(text.isNotNull(), F.raise_error(F.lit("not a vector")))


METRICS = {"l2": l2, "ip": negative_inner_product, "cosine": cosine_distance, "l1": l1}


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def nearest(table: DataFrame, query: list[float], k: int = 10, metric: str = "l2", id_column: str = "vec_id", vector_column: str = "embedding", gate: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Exact top k by distance, ties by id: one pass and k rows a task. ``allowed``: ids that may be found (an empty table: none)."""
    rows = table if gate is None else table.where(gate)
    if allowed is not None:
        rows = rows.join(allowed.select(id_column), id_column, "left_semi")
    d = F.round(METRICS[metric](F.col(vector_column), literal(query)), 6)
    return rows.select(id_column, d.alias("distance")).where("distance is not null").orderBy("distance", id_column).limit(k)


def nearest_many(table: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", block: int = 4096) -> DataFrame:
    """The k nearest of each query (query_id, query): blocks of queries are sent to the vectors, each task keeps k rows a query.

    One block is answered lazily; of more, each block's k rows a query go to the scratch folder, so that the driver holds one block at a time.
    """
    spark = table.sparkSession
    held = iter(queries.select("query_id", "query").orderBy("query_id").toLocalIterator())
    kind = queries.schema["query_id"].dataType
    first, second = list(islice(held, block)), list(islice(held, block))
    if not second:
        return _best(_nearest_block(table, first, kind, k, metric), k)
    path = scratch(spark, "nearest")
    for rows in chain([first, second], iter(lambda: list(islice(held, block)), [])):
        _best(_nearest_block(table, rows, kind, k, metric), k).drop("rank").write.mode("append").parquet(path)
    return _best(spark.read.parquet(path), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_block(table: DataFrame, queries: list, kind: T.DataType, k: int, metric: str) -> DataFrame:
    """query_id, vec_id, distance: of each task the k nearest of each query."""
    held = [(r.query_id, list(r.query)) for r in queries]
    id_kind = table.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("vec_id", id_kind), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array([v for _, v in held], dtype=np.float64)
        best = [[] for _ in held]
        for batch in batches:
            ids, x = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            for i, v in enumerate(q):
                if metric == "l1":
                    d = np.abs(x - v).sum(axis=1)
                elif metric == "l2":
                    d = np.sqrt(((x - v) ** 2).sum(axis=1))
                else:
                    d = -(x @ v)
                    if metric == "cosine":
                        with np.errstate(invalid="ignore", divide="ignore"):
                            d = 1 + np.clip(d / (np.linalg.norm(x, axis=1) * np.linalg.norm(v)), -1, 1)
                top = np.argpartition(d, min(k, len(d)) - 1)
                edge = d[top[min(k, len(d)) - 1]]
                # distances that round alike tie by id
                best[i] = sorted(best[i] + [(round(float(d[j]), 6), ids[j]) for j in np.flatnonzero(d <= edge + 1e-6)])[:k]
        rows = [(held[i][0], vid, d) for i, b in enumerate(best) for d, vid in b]
        if rows:
            kinds = [to_arrow_type(f.dataType) for f in schema.fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return table.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, schema)


# --- quantization -------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def codebook(bits: int) -> np.ndarray:
    """Lloyd-Max levels of a standard normal variable."""
    n = 1 << bits
    x = np.linspace(-6, 6, 200_001)
    p = np.exp(-x * x / 2)
    levels = np.quantile(np.random.default_rng(0).normal(size=100_000), (np.arange(n) + 0.5) / n)
    for _ in range(200):
        cell = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        mass = np.bincount(cell, p, n)
        levels = np.where(mass > 0, np.bincount(cell, p * x, n) / np.maximum(mass, 1e-300), levels)
    return levels


@lru_cache(maxsize=16)
def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def quantize(x: np.ndarray, bits: int) -> np.ndarray:
    """Decoded quantization of each row: unit vector, rotated, coded with ``bits`` bits a component, scaled to keep its length, turned back."""
    if not 2 <= bits <= 8:
        raise ValueError("2 to 8 bits")
    length = np.linalg.norm(x, axis=1, keepdims=True)
    if (length == 0).any():
        raise ValueError("a zero vector cannot be quantized")
    turn, levels = rotation(x.shape[1]), codebook(bits)
    z = (x / length) @ turn.T * np.sqrt(x.shape[1])
    coded = levels[np.searchsorted((levels[1:] + levels[:-1]) / 2, z)]
    unit = coded / np.sqrt(x.shape[1])
    scale = ((z / np.sqrt(x.shape[1])) * unit).sum(axis=1, keepdims=True) / (unit * unit).sum(axis=1, keepdims=True)
    return (unit * scale) @ turn * length


def quantize_size(size: int, bits: int = 4) -> int:
    """Bytes of a code with its scale and norm."""
    return -(-size * bits // 8) + 8


def with_quantized(table: DataFrame, bits: int = 4, vector_column: str = "embedding") -> DataFrame:
    """``table`` with a column ``approx``: each vector's quantization; null vectors stay null."""
    schema = T.StructType([*table.schema.fields, T.StructField("approx", T.ArrayType(T.FloatType()))])
    at = table.columns.index(vector_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            some = [i for i in range(batch.num_rows) if column[i].is_valid]
            out: list = [None] * batch.num_rows
            if some:
                x = np.array([column[i].as_py() for i in some], dtype=np.float64)
                coded = x.any(axis=1)  # zero is its own code
                if coded.any():
                    x[coded] = quantize(x[coded], bits)
                for i, v in zip(some, x, strict=True):
                    out[i] = v.astype(np.float32).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=schema.names)

    return table.mapInArrow(run, schema)


def nearest_codes(table: DataFrame, query: list[float], k: int = 10, bits: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest by quantized distance alone, without a look at the vectors: recall grows with ``bits``."""
    coded = with_quantized(table.select(id_column, vector_column).where(F.col(vector_column).isNotNull()), bits, vector_column)
    return coded.select(id_column, F.round(l2(F.col("approx"), literal(query)), 6).alias("distance")).orderBy("distance", id_column).limit(k)


def nearest_two_stage(table: DataFrame, query: list[float], k: int = 10, bits: int = 4, window: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The exact top k: of ``window * k`` rows by quantized distance, the k-th exact distance bounds which rows can still be among them.

    A row is no nearer than its quantized distance less its quantization error, so only rows beyond the bound by that are left out.
    """
    d = F.col(vector_column)
    exact = l2(d, literal(query))
    coded = with_quantized(table.select(id_column, vector_column).where(d.isNotNull()), bits, vector_column)
    rows = coded.select(id_column, vector_column, l2(F.col("approx"), literal(query)).alias("d"), l2(d, F.col("approx")).alias("error"))
    first = rows.orderBy("d", id_column).limit(max(window, 1) * k).select(exact.alias("e")).orderBy("e").limit(k)
    edge = first.agg((F.max("e") * (1 + 1e-9) + 2e-6).alias("edge"))  # distances that round alike tie by id
    low = F.col("d") * (1 - 1e-9) - F.col("error") * (1 + 1e-9)
    near = rows.crossJoin(F.broadcast(edge)).where((low <= F.col("edge")) | F.isnan(low))
    return near.select(id_column, F.round(exact, 6).alias("distance")).orderBy("distance", id_column).limit(k)


# --- scores of distances ------------------------------------------------------------------------------------------------------------


def cosine_score(d: Column) -> Column:
    return 1 - d


def l2_score(d: Column) -> Column:
    return -(d * d)


def negated_score(d: Column) -> Column:
    """Of a negative inner product, or an edit distance."""
    return -d
