"""Live meters as Structured Streaming jobs; each works on a batch DataFrame of the same columns too (its twin in tests).

Input: ts (event time), track, x. Late rows beyond the watermark are dropped and counted in the query's progress.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from undula.sources.shared import shared_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A folder's event files as a stream of ts, track, x."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    return stream.select("ts", F.col("user_id").alias("track"), ((F.col("value") - 250) / 250).alias("x"))


def block_meter(samples: DataFrame, block: str = "1 day", late: str = "1 hour") -> DataFrame:
    """track, start, rms, peak, clipped (samples at full scale) of each block of time."""
    d = samples.withWatermark("ts", late) if samples.isStreaming else samples
    out = d.groupBy(F.window("ts", block).alias("w"), "track").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"), F.count_if(F.abs("x") >= 1).alias("clipped"))
    return out.select("track", F.col("w.start").alias("start"), "rms", "peak", "clipped")


def mix_meter(samples: DataFrame, block: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The same for all tracks together."""
    return block_meter(samples.withColumn("track", F.lit(-1).cast("long")), block, late)


def short_term_level(samples: DataFrame, length: str = "3 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """track, start, level (dB) of a window that slides."""
    d = samples.withWatermark("ts", late) if samples.isStreaming else samples
    out = d.groupBy(F.window("ts", length, slide).alias("w"), "track").agg(F.avg(F.col("x") * F.col("x")).alias("e"))
    return out.select("track", F.col("w.start").alias("start"), (10 * F.log10(F.greatest("e", F.lit(1e-12)))).alias("level"))


def activity(samples: DataFrame, threshold: float, gap: str = "6 hours", least: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """track, start, end, n of stretches of samples over a level, closed by a gap; short ones are left out."""
    d = samples.withWatermark("ts", late) if samples.isStreaming else samples
    d = d.filter(F.abs("x") > threshold)
    out = d.groupBy(F.session_window("ts", gap).alias("w"), "track").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.filter(F.col("end") - F.col("start") >= F.expr(f"interval {least}")).select("track", "start", "end", "n")


def followed(x: np.ndarray, alpha: float, y: float, block: int = 128) -> np.ndarray:
    """y[k] = y[k-1] + alpha * (x[k] - y[k-1]), a block of samples at a time as one product with the block's impulse responses."""
    k = np.arange(block)
    keep = (1 - alpha) ** (k + 1.0)
    within = np.where(k[:, None] >= k, alpha * (1 - alpha) ** np.maximum(k[:, None] - k, 0.0), 0.0)
    out = np.empty(len(x))
    for a in range(0, len(x), block):
        part = x[a : a + block]
        n = len(part)
        out[a : a + n] = within[:n, :n] @ part + keep[:n] * y
        y = out[a + n - 1]
    return out


MARK = "ts timestamp, track long, x double"
#: When a closed stream's marker stands, after all input.
FAR = datetime(2250, 1, 1)  # within what nanoseconds hold


class Meter:
    """An append-mode job over a stream of ts, track, x. run() takes what is present and adds what event time has closed, close() ends
    the stream: a marker far in the future moves the watermark behind all input, so every window closes but the marker's own.

    Results are Parquet files in the shared folder, each row written once; state that is closed is dropped. Late rows are
    those that the progress of the runs counts as dropped by the watermark (late())."""

    def __init__(self, source: DataFrame, job: Callable[[DataFrame], DataFrame]):
        self.spark = source.sparkSession
        self.folder = f"{shared_folder(self.spark)}/meter-{uuid.uuid4().hex}"
        self.mark([])
        marks = self.spark.readStream.schema(MARK).parquet(f"{self.folder}/marks")
        self.out = job(source.select("ts", "track", "x").unionByName(marks))
        self.progress: list = []

    def mark(self, rows: list) -> None:
        self.spark.createDataFrame(rows, MARK).coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")

    def run(self) -> Meter:
        write = self.out.writeStream.outputMode("append").format("parquet").option("path", f"{self.folder}/rows").option("checkpointLocation", f"{self.folder}/state")
        query = write.trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += query.recentProgress
        return self

    def close(self) -> Meter:
        self.mark([(FAR, None, float("inf"))])  # over any threshold, so that no filter holds it back
        return self.run()

    def state_rows(self) -> int:
        """Rows of state after the last run."""
        return sum(o["numRowsTotal"] for o in self.progress[-1]["stateOperators"])

    def late(self) -> int:
        return sum(o["numRowsDroppedByWatermark"] for p in self.progress for o in p["stateOperators"])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.out.schema).parquet(f"{self.folder}/rows")


def finished(source: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a job gives for all input now present."""
    return Meter(source, job).run().close().rows()


def in_order(samples: DataFrame, alpha: float = 0.2, late: str = "1 hour", idle: timedelta = timedelta(hours=1)) -> DataFrame:
    """track, ts, y: a one-pole level follower in order of event time, whatever micro-batch a row comes in.

    A row waits in its track's state until the watermark has passed it, as nothing can come before it then; rows later than
    that are dropped and counted. After a gap of more than `idle` the follower starts from 0 again, so a track's state, which
    ends that long after its last row, is never missed. State holds the rows of the time that rows may be late by, not more."""
    rest = int(idle.total_seconds() * 1_000_000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y, last, ts, x = state.get if state.exists else (0.0, None, [], [])
        frames = [] if state.hasTimedOut else list(parts)
        ts = np.concatenate([np.asarray(ts, np.int64), *(f["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for f in frames)])
        x = np.concatenate([np.asarray(x, float), *(f["x"].to_numpy(float) for f in frames)])
        order = np.lexsort((x, ts))
        ts, x = ts[order], x[order]
        mark = state.getCurrentWatermarkMs()
        n = int(np.searchsorted(ts, mark * 1000, "right"))
        out = np.empty(n)
        starts = [0, *(np.flatnonzero(np.diff(ts[:n]) > rest) + 1).tolist(), n] if n else []
        for k, (a, b) in enumerate(pairwise(starts)):
            fresh = k > 0 or last is None or ts[a] - last > rest
            out[a:b] = followed(np.abs(x[a:b]), alpha, 0.0 if fresh else y)
            y, last = float(out[b - 1]), int(ts[b - 1])
        if n == len(ts) and (last is None or last + rest < mark * 1000):
            state.remove()
        else:
            state.update((y, last, ts[n:].tolist(), x[n:].tolist()))
            until = int(ts[n]) // 1000 if n < len(ts) else (last + rest) // 1000 + 1
            state.setTimeoutTimestamp(max(until, mark + 1))
        yield pd.DataFrame({"track": [key[0]] * n, "ts": ts[:n].astype("datetime64[us]"), "y": out})

    kept = "y double, last long, ts array<long>, x array<double>"
    return samples.withWatermark("ts", late).groupBy("track").applyInPandasWithState(run, "track long, ts timestamp, y double", kept, "append", GroupStateTimeout.EventTimeTimeout)


def smoothed(samples: DataFrame, alpha: float = 0.2, late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """track, ts, y: a one-pole level follower whose state is carried from chunk to chunk, so seams don't show. State ends when event time has gone an idle time beyond a track's last row."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        y = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(parts)).sort_values(["ts", "x"])
        out = followed(np.abs(pdf["x"].to_numpy()), alpha, y)
        y = out[-1] if len(out) else y
        state.update((float(y),))
        last = int(pdf["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"track": key[0], "ts": pdf["ts"], "y": out})

    return samples.withWatermark("ts", late).groupBy("track").applyInPandasWithState(run, "track long, ts timestamp, y double", "y double", "append", GroupStateTimeout.EventTimeTimeout)
