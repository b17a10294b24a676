"""Speech progress as a stream: framed JSON lines, latest word of a request, annotations merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "requestId bigint, event string, charIndex int, charLength int, ts timestamp"


def frames(lines: DataFrame) -> DataFrame:
    """Events of newline-framed JSON (column value); lines that are no event go."""
    return lines.select(F.from_json("value", EVENT).alias("e")).where("e IS NOT NULL AND e.requestId IS NOT NULL").select("e.*")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return frames(spark.readStream.text(path))


def latest(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Furthest word of every request; repeats within the watermark count once."""
    fresh = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["requestId", "event", "charIndex"])
    return fresh.where("event = 'word'").groupBy("requestId").agg(F.max("charIndex").alias("char_index"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "requestId").agg(F.count(F.lit(1)).alias("n"))


def upsert(events: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Every batch is merged into a table version of its own, named by the batch, so a batch that runs twice writes the same."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        merge(batch, old).write.mode("overwrite").parquet(f"{path}/v{number}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
