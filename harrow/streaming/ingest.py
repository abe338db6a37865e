"""Incremental ingest: segments, tombstones, upserts, compaction, and structured streams into them.

An index folder holds ``segments`` (Parquet, partitioned by ``origin``, the caller or a stream, and batch ``seg``). Each row has an id, a sequence number and whether it is a deletion; the
latest sequence of an id wins, and of two rows of one sequence that with the larger values. A query reads what is there, so new rows count at once, at the
statistics they will have after compaction. Kept to what Spark's writer gives: where a table format with transactions is at hand, use that.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IncrementalTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, id_column: str = "doc_id"):
        self.spark, self.path, self.schema, self.id = spark, path.rstrip("/"), schema, id_column

    def _write(self, rows: DataFrame, seg: int, deleted: bool, origin: str = "caller", base: int = 0) -> None:
        out = rows.withColumn("_seq", F.lit(base + seg).cast("long")).withColumn("_deleted", F.lit(deleted)).withColumn("origin", F.lit(origin)).withColumn("seg", F.lit(seg).cast("long"))
        # a batch that is run again replaces its own segment and nothing else
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin", "seg").parquet(f"{self.path}/segments")

    def upsert(self, rows: DataFrame, seg: int) -> None:
        """Writes segment ``seg`` of the caller; a number that is used again replaces that segment. ``next_seq`` gives one after all that is there."""
        self._write(rows, seg, False)

    def next_seq(self) -> int:
        """The sequence after the latest."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return self.raw().agg(F.coalesce(F.max("_seq"), F.lit(-1))).first()[0] + 1

    def delete(self, ids: DataFrame, seg: int) -> None:
        columns = self.spark.createDataFrame([], self.schema)
        self._write(ids.select(self.id).unionByName(columns.limit(0), allowMissingColumns=True), seg, True)

    def raw(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _seq long, _deleted boolean, origin string, seg long").parquet(f"{self.path}/segments")

    def current(self) -> DataFrame:
        """The live rows: of each id the latest, unless it is a deletion. One exchange on the id, with partial aggregation."""
        raw = self.raw()
        own = [c for c in raw.columns if c not in ("_seq", "_deleted", "origin", "seg")]
        latest = raw.groupBy(self.id).agg(F.max(F.struct("_seq", "_deleted", *[c for c in own if c != self.id])).alias("x"))
        return latest.where("not x._deleted").select(*[F.col(self.id) if c == self.id else F.col(f"x.{c}").alias(c) for c in own])

    def compact(self, path: str) -> IncrementalTable:
        """Live rows as the one segment of a new folder; tombstones and superseded rows go. The old folder stays for readers that began before."""
        new = IncrementalTable(self.spark, path, self.schema, self.id)
        top = self.raw().agg(F.coalesce(F.max("_seq"), F.lit(0))).first()[0]
        new.upsert(self.current(), top)
        return new

    def stream_into(self, stream: DataFrame, checkpoint: str):
        """Starts a query that upserts each micro-batch as a segment of the stream; available data only, then it ends.

        The stream's batches count from the sequence that was next when it first began (kept beside the segments), so a batch that is run again replaces itself, and
        no batch replaces what others wrote.
        """
        origin = f"stream-{zlib.crc32(checkpoint.encode()):08x}"
        begun = f"{self.path}/streams/{origin}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{begun}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            self.spark.createDataFrame([(self.next_seq(),)], "base long").coalesce(1).write.mode("overwrite").parquet(begun)
        base = self.spark.read.parquet(begun).first()["base"]
        return stream.writeStream.foreachBatch(lambda batch, n: self._write(batch, n, False, origin, base)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, id_column: str, time_column: str, late: str) -> DataFrame:
    return stream.withWatermark(time_column, late).dropDuplicatesWithinWatermark([id_column])


def windowed_counts(events: DataFrame, key: str, time_column: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by key in tumbling (or sliding) windows; the same plan for a stream and for a table."""
    rows = events if late is None else events.withWatermark(time_column, late)
    w = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, key: str, time_column: str, gap: str) -> DataFrame:
    return events.groupBy(F.session_window(time_column, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
