"""Incremental ingest: new files of a folder become bundles, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.documents import content_hash


def stream_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, content_hash, content) of the files that appear under ``path``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select("path", content_hash(F.col("content")).alias("content_hash"), "content")


def ingest(files: DataFrame, seen_path: str, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call ``handle`` with the files of each micro-batch whose content is new; hashes are kept as Parquet at ``seen_path``.

    A batch that fails before its hashes are written is handled again, so ``handle`` should overwrite by hash.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["content_hash"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen_path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(seen_path), "content_hash", "left_anti")
        fresh = fresh.persist()
        if not fresh.isEmpty():
            handle(fresh)
            fresh.select("content_hash").write.mode("append").parquet(seen_path)
        fresh.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by time window; works on streams (with a watermark) and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
