"""Streaming twins: the same rollups over landing files, with late rows allowed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_callers(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests, errors and cost per caller and hour; of a stream or a table. Rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "caller").agg(
        F.count("*").alias("events"), F.count_if(~F.lower("status").rlike(r"^(ok|success|true|2\d\d|)$")).alias("errors"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost")
    ).select("caller", F.col("w.start").alias("window_start"), "events", "errors", "cost")


def session_loops(events: DataFrame, gap: str = "30 seconds", least: int = 3, watermark: str = "1 hour") -> DataFrame:
    """Sessions of calls at most ``gap`` apart with ``least`` different times, as ``loop_cadence`` has them."""
    rows = (events.withWatermark("ts", watermark) if events.isStreaming else events).select("caller", "ts").dropDuplicates(["caller", "ts"])
    # a window's end opens the next one, so a gap of exactly that length needs a moment more
    out = rows.groupBy(F.session_window("ts", f"{gap} 1 microsecond").alias("w"), "caller").agg(F.count("*").alias("calls"))
    return out.where(F.col("calls") >= least).select("caller", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that land in a folder, as a stream."""
    return spark.readStream.schema(schema).json(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, written once; run again it goes on where it stopped."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(slices: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream has written after all slices: each lands in a folder, is read to its end, and the stream stops.

    Every run starts anew from the one checkpoint in ``folder``: offsets, watermark and state come from there. Within a run
    the state goes on from micro-batch to micro-batch; at its end an empty one moves the watermark and lets go
    of what is finished. Rows of a slice that are later than the watermark of the slices before are dropped.
    """
    spark = slices[0].sparkSession
    source, out = f"{folder}/landed", f"{folder}/out"
    for rows in slices:
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        query = write_stream(build(stream), out, f"{folder}/checkpoint")
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return spark.read.schema(build(slices[0]).schema).parquet(out)
