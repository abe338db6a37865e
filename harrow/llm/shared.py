"""Where the operators of this subpackage keep intermediate tables, and how they cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A session on one machine (tests) may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: a replicated cut of the lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for f in df.inputFiles():
        root = f[: f.rfind("/")]
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if root.split(":")[-1].lstrip("/").startswith(base.split(":")[-1].lstrip("/")):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return


#: Rows of a table with unique keys that ``spread_join`` broadcasts (about 60 bytes each); beyond that it spreads each key over so many tasks.
BROADCAST_ROWS, SALTS = 500_000, 16


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined to ``right``, whose keys are unique and which is counted first: broadcast up to ``most`` rows, else by a shuffle in which the rows of one
    key are spread over ``SALTS`` tasks. Rows of ``left`` without a key go round the exchange."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), key, how)
    salt = F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(SALTS)).cast("int")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = left.where(F.col(key).isNotNull()).withColumn("_salt", salt).join(salted, [key, "_salt"], how).drop("_salt")
    return found if how == "inner" else found.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


#: Bytes of texts in a batch that an operator works on at once.
TEXT_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of a column of strings, binaries or lists of integers, whatever batches the session makes; a
    longer value stands alone."""
    for batch in batches:
        values = batch.column(column)
        size = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        size = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = end[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(end, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def on_worker(cache: dict, key, make: Callable):
    """A value that a Python worker makes once and keeps between tasks."""
    if key not in cache:
        cache[key] = make()
    return cache[key]
