"""Reading and writing tables: Parquet first, and the text formats Spark brings along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_any(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON, text or JDBC; a schema is asked for where the format has none, so that nothing is inferred by a scan."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**options).format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: list[str]) -> None:
    """A table whose joins and groupings on ``key`` need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*sort).saveAsTable(table)
