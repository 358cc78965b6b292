"""Streams: question logs in windows, and file changes applied as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataloom.schema import ASK_LOG


def log_stream(spark: SparkSession, path: str, schema: str = ASK_LOG, files_per_batch: int = 100) -> DataFrame:
    """Rows of JSON lines as files arrive; malformed lines are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    got = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return got.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def ask_windows(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, matched, n, answer_bytes) by window; rows later than `late` are left out once their window is closed."""
    got = log.withWatermark("ts", late).groupBy(F.window("ts", width), "matched").agg(F.count("*").alias("n"), F.sum("answer_bytes").alias("answer_bytes"))
    return got.select(F.col("window.start").alias("start"), "matched", "n", "answer_bytes")


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each path: of equal times the greater kind."""
    return changes.groupBy("path").agg(F.max(F.struct("ts", "kind")).alias("c")).select("path", "c.ts", "c.kind")


def apply_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls apply(last change of each path, batch number) for every batch of what has come, then ends.

    A batch may come twice after a failure, under the same number.
    """
    def each(batch: DataFrame, number: int) -> None:
        apply(newest(batch), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
