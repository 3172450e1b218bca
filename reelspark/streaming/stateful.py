"""Streaming variants: anchored segments and tracks kept as state per video, and windowed counts.

Frames of a video have to arrive in order of frame_idx, over any number of micro-batches; within a
batch they are sorted here. State is one small row per video and goes when a video is idle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelspark.operators.track import Tracker

SEGMENTS = "video long, segment int, start_frame int, end_frame int, n int, anchor double"
TRACKS = "video long, frame_idx int, det_ord int, track_id int"


def streamed_segments(frames: DataFrame, tolerance: float, every_n: int, idle: str = "10 minutes") -> DataFrame:
    """Anchored segments of scalar frames (video, frame_idx, v); one comes out when it closes or its video is idle."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, start, last, n, anchor = state.get if state.exists else (0, -1, -1, 0, 0.0)
        closed = []

        def close() -> None:
            nonlocal start
            if start >= 0:
                closed.append((key[0], segment, start, last + every_n - 1, n, anchor))
            start = -1

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(batches).sort_values("frame_idx")
            for at, v in zip(rows["frame_idx"].tolist(), rows["v"].tolist(), strict=True):
                if pd.isna(v):
                    close()
                elif start >= 0 and abs(v - anchor) <= tolerance:
                    last, n = at, n + 1
                else:
                    close()
                    segment, start, last, n, anchor = segment + 1, at, at, 1, v
            state.update((segment, start, last, n, anchor))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return frames.groupBy("video").applyInPandasWithState(step, SEGMENTS, "segment int, start int, last int, n int, anchor double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def streamed_tracks(detections: DataFrame, threshold: float, max_age: int, idle: str = "10 minutes") -> DataFrame:
    """Greedy tracks of detections (video, frame_idx, det_ord, box); a frame's detections arrive in one batch."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker, frame = Tracker(threshold, max_age), None
        if state.exists:
            text, tracker.next, frame = state.get
            tracker.tracks = json.loads(text)
        rows, out = pd.concat(batches).sort_values(["frame_idx", "det_ord"]), []
        for at, group in rows.groupby("frame_idx"):
            for _ in range(min(int(at) - frame - 1, max_age + 1) if frame is not None else 0):
                tracker.update([])
            frame = int(at)
            boxes = [{"box": [float(x) for x in b], "det": int(k)} for b, k in zip(group["box"], group["det_ord"], strict=True)]
            out += [(key[0], frame, t["det"], t["track"]) for t in tracker.update(boxes)]
        state.update((json.dumps(tracker.tracks), tracker.next, frame))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKS.split(", ")])

    return detections.groupBy("video").applyInPandasWithState(step, TRACKS, "tracks string, next int, frame int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def reduce_batches(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], folder: str):
    """Write ``reduce`` of each micro-batch under its number, so that a repeated batch replaces itself."""
    def one(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(one)
