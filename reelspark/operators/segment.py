"""Sampling, segmentation and chunking of timelines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.geometry import bound
from reelspark.operators.fold import Fold, native_fold, ordered_fold


def every_nth(frames: DataFrame, n: int, frame: str = "frame_idx", most: int | None = None) -> DataFrame:
    """Frames whose index is a multiple of n; with ``most``, the first so many multiples, as a bound the scan can use."""
    out = frames.where(F.col(frame) % n == 0)
    return out if most is None else out.where(F.col(frame) < n * most)


def effective_frames(requested: Column, frames: Column, fps: Column, seconds_per_frame: Column, most: int = 768) -> Column:
    step = seconds_per_frame * fps
    by_time = F.greatest(F.lit(1), F.when(step > 0, (frames / step).cast("int")).otherwise(requested))
    return F.least(F.lit(most), F.when(seconds_per_frame > 0, by_time).otherwise(requested))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _stepped(start: pd.Series, end: pd.Series, step: pd.Series) -> pd.Series:
    """Positions start, start + step, ... below end, summed up step by step: the rounding of the sums decides their frames."""
    def one(s: float, e: float, d: float) -> np.ndarray | None:
        if not s < e:  # also where one of them is missing
            return None if np.isnan([s, e, d]).any() else np.zeros(0, np.int32)
        sums = np.full(int((e - s) / d) + 3, d)
        sums[0] = s
        sums = np.cumsum(sums)
        return sums[sums < e].astype(np.int32)

    return pd.Series([one(*x) for x in zip(start, end, step, strict=True)])


def _span(start_s: Column, end_s: Column, total: Column, video_fps: Column, fps: Column) -> tuple[Column, Column, Column]:
    """Start, end and step of the positions of ``resampled``."""
    rate = F.when(video_fps > 0, video_fps.cast("double")).otherwise(F.lit(25.0))
    start = (start_s * rate).cast("int").cast("double")
    end = F.when(end_s > start_s, F.least((end_s * rate).cast("int"), total.cast("int"))).otherwise(total.cast("int")).cast("double")
    return start, end, F.when(fps > 0, F.greatest(F.lit(1.0), rate / fps)).otherwise(rate)


def resampled(start_s: Column, end_s: Column, total: Column, video_fps: Column, fps: Column) -> Column:
    """Frame numbers sampled ``fps`` times a second between two times of a video of ``total`` frames.

    An end that is not after the start means the end of the video; a video without a rate has 25
    frames a second; a rate of 0 samples once a second; a rate above the video's takes each frame once.
    """
    return _stepped(*_span(start_s, end_s, total, video_fps, fps))


def floor_sums(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of (a * i + b) // m over i < n, by Euclid's steps; a, b and a * n + b stay below 2^62, m is positive."""
    n, m, a, b = (x.astype(np.int64).copy() for x in (n, m, a, b))
    total, open_ = np.zeros(len(n), np.int64), np.arange(len(n))
    while len(open_):
        half = np.where(n % 2 == 0, (n // 2) * (n - 1), n * ((n - 1) // 2))
        total[open_] += half * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        on = top >= m
        open_, n, m, a, b = open_[on], (top // m)[on], a[on], m[on], (top % m)[on]
    return total


def _stepped_sums(start: np.ndarray, end: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, last one and sum of the whole parts of start, start + step, ... below end, without the positions themselves.

    The sums are those of doubles added up step by step. Between two powers of two doubles are evenly
    spaced, so there each rounded step is the same (from the second on, where a step ends halfway
    between two doubles); such a run is counted at once, as whole multiples of the spacing. ``start`` is
    0 or more, ``step`` 1 or more, ``end`` below 2^31.
    """
    count, last, total = np.zeros(len(start), np.int64), np.zeros(len(start)), np.zeros(len(start), np.int64)
    at, runs = np.flatnonzero(start < end), []
    t, e, d = start[at], end[at], step[at]
    while len(at):
        count[at] += 1
        last[at] = t
        total[at] += t.astype(np.int64)
        before, t = t, t + d
        on = t < e
        at, before, t, e, d = at[on], before[on], t[on], e[on], d[on]
        low = np.ldexp(1.0, np.frexp(t)[1] - 1)
        again = t + d
        even = (before >= low) & (again < np.minimum(e, 2 * low))
        if even.any():
            unit = low[even] * 2.0**-52
            first, gap = (t[even] / unit).astype(np.int64), ((again - t)[even] / unit).astype(np.int64)
            bound_ = (np.minimum(e, 2 * low)[even] / unit).astype(np.int64)
            n = (bound_ - first - 1) // gap  # all of the run but its last, with which the loop goes on
            runs.append((at[even], n, (1 / unit).astype(np.int64), gap, first))
            t[even] = (first + n * gap) * unit
    if runs:
        rows, n, m, gap, first = (np.concatenate(x) for x in zip(*runs, strict=True))
        np.add.at(count, rows, n)
        np.add.at(total, rows, floor_sums(n, m, gap, first))
    return count, last, total


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("total", T.LongType())]))
def _stepped_totals(start: pd.Series, end: pd.Series, step: pd.Series) -> pd.DataFrame:
    s, e, d = (x.to_numpy(np.float64, na_value=np.nan) for x in (start, end, step))
    known = ~(np.isnan(s) | np.isnan(e) | np.isnan(d))
    count, last, total = _stepped_sums(*(np.where(known, x, 0.0) for x in (s, e, d)))
    some = count > 0
    number = lambda x, there, kind: pd.Series(np.where(there, x, 0).astype(np.int64)).astype(kind).where(there, pd.NA)
    return pd.DataFrame({"n": number(count, known, "Int64"), "first": number(s, some, "Int32"), "last": number(last, some, "Int32"), "total": number(total, known, "Int64")})


def resampled_totals(start_s: Column, end_s: Column, total: Column, video_fps: Column, fps: Column) -> Column:
    """(n, first, last, total) of the frame numbers of ``resampled``: as many steps as the video's length has binary digits, and no list."""
    return _stepped_totals(*_span(start_s, end_s, total, video_fps, fps))


def even_choice(n: Column, k: Column) -> Column:
    """k of n positions, evenly spread, both ends included."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(2)) - 1), lambda i: F.bround(i * (n - 1) / (F.greatest(k, F.lit(2)) - 1), 0).cast("int"))
    none = F.array().cast("array<int>")
    return F.when((k <= 0) | (n <= 0), none).when(k >= n, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).when(k == 1, F.array((n / 2).cast("int"))).otherwise(spread)


def euclid(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum()))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(1 - np.dot(a, b) / ((np.linalg.norm(a) + 1e-10) * (np.linalg.norm(b) + 1e-10)))


class _Anchored(Fold):
    def __init__(self, tolerance: float, every_n: int, distance: Callable, keys: tuple[str, ...]):
        self.tolerance, self.every, self.distance, self.keys = tolerance, every_n, distance, keys
        self.anchor, self.open, self.n = None, None, 0

    def _close(self) -> list[dict]:
        out, self.open, self.anchor = ([self.open] if self.open else []), None, None
        return out

    def step(self, row: dict) -> list[dict]:
        if row["enc"] is None:
            return self._close()
        enc = np.asarray(row["enc"], np.float64)
        out = [] if self.anchor is None or self.distance(self.anchor, enc) <= self.tolerance else self._close()
        if self.open is None:
            self.anchor, self.n = enc, self.n + 1
            self.open = {k: row[k] for k in self.keys} | {"segment": self.n, "start_frame": row["frame_idx"], "anchor": enc.tolist(), "frames": []}
        self.open["end_frame"] = row["frame_idx"] + self.every - 1
        self.open["frames"].append(row["frame_idx"])
        return out

    def end(self) -> list[dict]:
        return self._close()


def anchored_segments(frames: DataFrame, tolerance: float, every_n: int, distance: Callable = euclid, key: str = "video") -> DataFrame:
    """Runs of frames near the encoding that opened the run; a null encoding closes it.

    ``frames``: key, frame_idx, enc array<double>. Rows: key, segment, start_frame, end_frame, anchor, frames.
    """
    kind = frames.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, segment int, start_frame int, end_frame int, anchor array<double>, frames array<int>"
    return ordered_fold(frames.select(key, F.col("frame_idx").cast("int").alias("frame_idx"), F.col("enc").cast("array<double>").alias("enc")), [key], ["frame_idx"], lambda: _Anchored(tolerance, every_n, distance, (key,)), schema)


def anchored_runs(frames: DataFrame, tolerance: float, every_n: int, key: str = "video", value: str = "v") -> DataFrame:
    """The same for scalar values and short timelines, folded in the JVM. Rows: key, segment, start_frame, end_frame, n, anchor."""
    run = "struct<start_frame:int,end_frame:int,n:int,anchor:double>"
    start = F.struct(F.lit(None).cast(run).alias("open"), F.array().cast(f"array<{run}>").alias("runs"))

    def step(a: Column, x: Column) -> Column:
        fresh = F.struct(x["frame_idx"].alias("start_frame"), x["frame_idx"].alias("end_frame"), F.lit(1).alias("n"), x["value"].alias("anchor"))
        longer = F.struct(a["open"]["start_frame"].alias("start_frame"), x["frame_idx"].alias("end_frame"), (a["open"]["n"] + 1).alias("n"), a["open"]["anchor"].alias("anchor"))
        joins = a["open"].isNotNull() & (F.abs(x["value"] - a["open"]["anchor"]) <= tolerance)
        # The list of closed runs is copied only when a run closes.
        closed = F.when(a["open"].isNull() | F.coalesce(joins, F.lit(False)), a["runs"]).otherwise(F.array_append(a["runs"], a["open"]))
        return F.struct(F.when(x["value"].isNull(), F.lit(None).cast(run)).when(joins, longer).otherwise(fresh).alias("open"), closed.alias("runs"))

    folded = native_fold(F.struct(F.col("frame_idx").cast("int").alias("frame_idx"), F.col(value).cast("double").alias("value")), F.col("frame_idx"), start, step)
    runs = bound(folded, lambda a: F.when(a["open"].isNull(), a["runs"]).otherwise(F.array_append(a["runs"], a["open"])))
    rows = frames.groupBy(key).agg(runs.alias("runs")).select(key, F.posexplode("runs").alias("k", "r"))
    return rows.select(key, (F.col("k") + 1).alias("segment"), "r.start_frame", (F.col("r.end_frame") + every_n - 1).alias("end_frame"), "r.n", "r.anchor")


def islands(frames: DataFrame, every_n: int, key: str = "video", value: str = "v") -> DataFrame:
    """Runs of frames with a value, parted by frames without one."""
    by = W.partitionBy(key).orderBy("frame_idx")
    gaps = F.sum(F.col(value).isNull().cast("int")).over(by)
    runs = frames.withColumn("gap", gaps).where(F.col(value).isNotNull()).groupBy(key, "gap").agg(F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + every_n - 1).alias("end_frame"), F.count("*").alias("n"))
    return runs.drop("gap")


def clip_and_split(segments: DataFrame, fps: Column, total: Column, least_s: float, most_s: float) -> DataFrame:
    """Segments inside the video, in chunks of the longest duration; chunks under the shortest one go."""
    low, high = F.greatest(F.lit(1), (F.lit(least_s) * fps).cast("int")), F.greatest(F.lit(1), (F.lit(most_s) * fps).cast("int"))
    df = segments.withColumn("_end", F.least("end_frame", total - 1)).where(F.col("start_frame") <= F.col("_end")).withColumn("_low", low).withColumn("_high", high)
    df = df.withColumn("chunk_start", F.explode(F.sequence("start_frame", "_end", "_high")))
    df = df.withColumn("chunk_end", F.least(F.col("_end"), F.col("chunk_start") + F.col("_high") - 1))
    out = df.where(F.col("chunk_end") - F.col("chunk_start") + 1 >= F.col("_low"))
    if "frames" in segments.columns:
        out = out.withColumn("frames", F.filter("frames", lambda x: (x >= F.col("chunk_start")) & (x <= F.col("chunk_end"))))
    return out.drop("_end", "_low", "_high", "start_frame", "end_frame").withColumnsRenamed({"chunk_start": "start_frame", "chunk_end": "end_frame"})


def numbered_segments(segments: DataFrame, key: str = "video", person: str = "person_id") -> DataFrame:
    """Adds seg_no: the running number of a person's segments in a video."""
    return segments.withColumn("seg_no", F.row_number().over(W.partitionBy(key, person).orderBy("start_frame")))


def fixed_chunks(df: DataFrame, start: Column, end: Column, length: Column, one_if_short: bool = False) -> DataFrame:
    """Chunks [start + k length, ...) up to the end, as chunk, chunk_start, chunk_end."""
    n = F.ceil((end - start) / length).cast("int")
    if one_if_short:
        n = F.when((length <= 0) | (end - start <= length), 1).otherwise(n)
    df = df.withColumns({"_s": start.cast("double"), "_e": end.cast("double"), "_d": length.cast("double"), "_n": n}).where("_n > 0")
    df = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    df = df.withColumns({"chunk_start": F.col("_s") + F.col("chunk") * F.col("_d"), "chunk_end": F.when(F.col("chunk") == F.col("_n") - 1, F.col("_e")).otherwise(F.col("_s") + (F.col("chunk") + 1) * F.col("_d"))})
    return df.drop("_s", "_e", "_d", "_n")


def audio_chunk_length(duration: Column) -> Column:
    return F.when(duration < 60, F.greatest(F.lit(1), duration.cast("int"))).when(duration < 300, 60).otherwise(120)


def overlap_buckets(segments: DataFrame, buckets: Column, duration: Column, key: str = "media") -> DataFrame:
    """Texts of timed segments joined for each of a media's equal buckets of time; empty buckets stay.

    ``segments``: key, start, end, text, ord. A segment names the range of buckets that it touches,
    so the join is on (key, bucket) and no pair that does not overlap is made.
    """
    shape = segments.groupBy(key).agg(F.max(buckets).cast("int").alias("n"), F.max(duration).alias("dur")).where("n > 0 and dur > 0")
    grid = shape.select(key, "n", "dur", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"))
    edge = lambda k: F.when(k == F.col("n"), F.col("dur")).otherwise(k * (F.col("dur") / F.col("n")))
    grid = grid.select(key, "bucket", edge(F.col("bucket")).alias("b_start"), edge(F.col("bucket") + 1).alias("b_end"))
    width = F.col("dur") / F.col("n")
    inside = lambda x: F.least(F.greatest(x.cast("int"), F.lit(0)), F.col("n") - 1)
    touched = segments.select(key, "start", "end", "ord", "text").join(shape, key).where(F.trim("text") != "")
    touched = touched.withColumn("bucket", F.explode(F.sequence(inside(F.floor(F.col("start") / width) - 1), F.greatest(inside(F.floor(F.col("start") / width) - 1), inside(F.floor(F.col("end") / width) + 1)))))
    both = grid.join(touched.select(key, "bucket", "start", "end", "ord", F.trim("text").alias("text")), [key, "bucket"], "left")
    hit = ~((F.col("end") <= F.col("b_start")) | (F.col("start") >= F.col("b_end")))
    parts = F.collect_list(F.when(hit, F.struct("start", "ord", "text")))
    return both.groupBy(key, "bucket", "b_start", "b_end").agg(F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), " ").alias("text"))


class _Cuts(Fold):
    def __init__(self, threshold: float, cooldown: int, keys: tuple[str, ...]):
        self.threshold, self.cooldown, self.keys = threshold, cooldown, keys
        self.wait, self.known, self.scene = 0, False, 0

    def step(self, row: dict) -> list[dict]:
        cut = False
        if self.threshold > 0:
            if self.wait > 0:
                self.wait -= 1
            else:
                cut = self.known and row["diff"] is not None and row["diff"] > self.threshold
            self.known = True
            if cut:
                self.wait, self.known, self.scene = self.cooldown, False, self.scene + 1
        return [{k: row[k] for k in self.keys} | {"frame_idx": row["frame_idx"], "cut": cut, "scene_id": self.scene}]


def scene_cuts(frames: DataFrame, threshold: float, cooldown: int = 30, key: str = "video") -> DataFrame:
    """Cuts by the difference to the frame before, none for ``cooldown`` frames after one; scene_id counts them.

    ``frames``: key, frame_idx, diff (to the frame before). scene_id parts the keys of stateful operators.
    """
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, F.col("frame_idx").cast("int").alias("frame_idx"), F.col("diff").cast("double").alias("diff"))
    return ordered_fold(rows, [key], ["frame_idx"], lambda: _Cuts(threshold, cooldown, (key,)), f"{key} {kind}, frame_idx int, cut boolean, scene_id int")

