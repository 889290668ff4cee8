"""Streaming over events: an addition to the batch rollups, which give the same results.

Event times without a zone are read as UTC, as a watermark needs. Windowed counts use watermarks; the
limiter keeps its admitted times per user in state that expires.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.sources.tables import ensure_checkpoint_dir


def stream(spark: SparkSession, sf_dir: str, schema) -> DataFrame:
    """The events table as a stream with event time ``at``."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def windowed(rows: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling counts per type: start, event_type, n, total."""
    by = rows.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: user_id, start, n."""
    by = rows.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("start"), "n")


def limited(rows: DataFrame, most: int, seconds: float, late: str = "1 day") -> DataFrame:
    """event_id, admitted: fewer than ``most`` admissions per user in the last ``seconds``; refusals don't count."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for frame in frames:
            out = []
            for i, at in sorted(zip(frame["event_id"], frame["at"]), key=lambda x: (x[1], x[0])):
                now = at.timestamp()
                times = [t for t in times if now - t < seconds]
                out.append((i, len(times) < most))
                if len(times) < most:
                    times.append(now)
            yield pd.DataFrame(out, columns=["event_id", "admitted"])
        state.update((times,))
        state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000) if times else 0, state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("at", late).groupBy("user_id").applyInPandasWithState(step, "event_id bigint, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, written to and read from the shared folder."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def drained_complete(df: DataFrame) -> DataFrame:
    """The last state of an aggregation in complete mode."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
