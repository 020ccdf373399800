"""Streams: counts by window and session, and islands with state, all bounded by a watermark.

A watermark is the low-water mark of the batch operators: what lies before it is
final, is emitted once (append mode), and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events under a folder as a stream, with ``at``: ts as a timestamp."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    df = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(folder)
    return df.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, late: str, size: str, *by: str) -> DataFrame:
    return _counted(stream.withWatermark("at", late).groupBy(F.window("at", size), *by), *by)


def sliding(stream: DataFrame, late: str, size: str, step: str, *by: str) -> DataFrame:
    return _counted(stream.withWatermark("at", late).groupBy(F.window("at", size, step), *by), *by)


def sessions(stream: DataFrame, late: str, gap: str, *by: str) -> DataFrame:
    return _counted(stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("window"), *by), *by)


def _counted(grouped, *by: str) -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def islands(stream: DataFrame, late: str, gap_seconds: int, key: str) -> DataFrame:
    """Maximal stretches of a key's events without a gap above ``gap_seconds``: key, start, end, n.

    State holds a key's open stretches; each is emitted once the watermark has
    passed its end by the gap. Events later than the watermark are dropped by Spark.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for pdf in batches:
            runs += [[t, t, 1] for t in pdf["s"].tolist()]
        joined: list[list] = []
        for a, b, n in sorted(runs):
            if joined and a - joined[-1][1] <= gap_seconds:
                joined[-1][1] = max(joined[-1][1], b)
                joined[-1][2] += n
            else:
                joined.append([a, b, n])
        mark = state.getCurrentWatermarkMs() / 1000
        done = [x for x in joined if x[1] + gap_seconds < mark]
        rest = [x for x in joined if x[1] + gap_seconds >= mark]
        if rest:
            state.update(tuple([x[i] for x in rest] for i in range(3)))
            state.setTimeoutTimestamp(int((min(x[1] for x in rest) + gap_seconds + 1) * 1000))
        else:
            state.remove()
        if done:
            yield pd.DataFrame({key: [k[0]] * len(done), "start": [x[0] for x in done], "end": [x[1] for x in done], "n": [x[2] for x in done]})

    own = stream.withWatermark("at", late).select(key, "at", F.unix_micros("at").alias("us")).withColumn("s", F.floor(F.col("us") / 1_000_000))
    kind = dict(stream.dtypes)[key]
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start long, end long, n long", "a array<long>, b array<long>, n array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all there is, into Parquet under ``folder``, and reads that: windows the watermark has passed."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
