"""Box tracking and the recurrences along tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.operators.fold import run_fold
from reelspark.session import ready


def overlap(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


class Tracker:
    """Greedy tracks of one video. Tracks choose in list order: the unused box of largest overlap, the first of equal ones."""

    def __init__(self, threshold: float, max_age: int, recognise: Callable[[dict], tuple[str | None, float]] | None = None):
        self.threshold, self.max_age, self.recognise = threshold, max_age, recognise
        self.tracks: list[dict] = []
        self.next = 0

    def reset(self) -> None:
        """Forget the tracks; numbers go on."""
        self.tracks = []

    def update(self, boxes: list[dict]) -> list[dict]:
        """Boxes ({"box", ...}) of the next frame; returns them with track, label and similarity, in track order."""
        used: set[int] = set()
        kept = []
        for t in self.tracks:
            best, at = self.threshold, None
            for k, b in enumerate(boxes):
                if k not in used and (v := overlap(t["box"], b["box"])) > best:
                    best, at = v, k
            if at is not None:
                used.add(at)
                kept.append({**boxes[at], "track": t["track"], "label": t["label"], "sim": t["sim"], "age": 0})
            elif t["age"] + 1 <= self.max_age:
                kept.append({**t, "age": t["age"] + 1})
        for k, b in enumerate(boxes):
            if k not in used:
                kept.append({**b, "track": self.next, "label": None, "sim": 0.0, "age": 0})
                self.next += 1
        self.tracks = kept
        active = [t for t in kept if t["age"] == 0]
        if self.recognise:
            for t in active:
                if t["label"] is None:
                    t["label"], t["sim"] = self.recognise(t)
        return active


class _Frames:
    """The same tracks over columns of many videos' rows, a frame at a time; frames without boxes count as empty ones.

    A track is [x1, y1, x2, y2, area, number, label, similarity, age].
    """

    def __init__(self, threshold: float, max_age: int, recognise: Callable | None):
        self.threshold, self.max_age, self.recognise = threshold, max_age, recognise
        self.tracks: list[list] = []
        self.next, self.key, self.frame, self.scene = 0, None, None, None

    def run(self, keys: list, frames: list, scenes: list | None, boxes: list[list[float]], ends: list[int], row: Callable[[int], dict] | None) -> tuple[list[int], list[list]]:
        """Places and tracks (number, label, similarity) of the rows; ``ends``: where each frame's rows end."""
        places, out, start = [], [], 0
        max_age, recognise = self.max_age, self.recognise
        for end in ends:
            key, frame, tracks = keys[start], frames[start], self.tracks
            if self.frame is None or key != self.key:
                tracks, self.next, self.scene = [], 0, None
            elif (missed := frame - self.frame - 1) > 0:
                for t in tracks:
                    t[8] += missed
                tracks = [t for t in tracks if t[8] <= max_age]
            self.key, self.frame = key, frame
            if scenes is not None:
                for k in range(start, end):
                    if scenes[k] != self.scene:
                        self.scene, tracks = scenes[k], []
            kept, free = [], list(range(start, end))
            for t in tracks:
                a0, a1, a2, a3, area = t[:5]
                best, at = self.threshold, -1
                for k in free:
                    b0, b1, b2, b3, other = boxes[k]
                    w = (a2 if a2 < b2 else b2) - (a0 if a0 > b0 else b0)
                    h = (a3 if a3 < b3 else b3) - (a1 if a1 > b1 else b1)
                    both = w * h if w > 0 and h > 0 else 0.0
                    union = area + other - both
                    if union > 0 and both / union > best or union <= 0 and 0.0 > best:
                        best, at = both / union if union > 0 else 0.0, k
                if at >= 0:
                    free.remove(at)
                    places.append(at)
                    kept.append([*boxes[at], *t[5:8], 0])
                    out.append(kept[-1])
                elif t[8] < max_age:
                    t[8] += 1
                    kept.append(t)
            for k in free:
                places.append(k)
                kept.append([*boxes[k], self.next, None, 0.0, 0])
                out.append(kept[-1])
                self.next += 1
            if recognise:
                for n in range(len(places) - (end - start), len(places)):
                    t = out[n]
                    if t[6] is None:
                        t[6], t[7] = recognise({**row(places[n]), "box": t[:4], "track": t[5], "label": None, "sim": t[7], "age": 0})
            self.tracks, start = kept, end
        return places, [(t[5], t[6], t[7]) for t in out]


def tracked(detections: DataFrame, threshold: float = 0.3, max_age: int = 30, recognise: Callable | None = None, key: str = "video") -> DataFrame:
    """(key, frame_idx, det_ord, track_id, label, sim) of each detection.

    ``detections``: key, frame_idx, det_ord, box (x1, y1, x2, y2), perhaps enc and scene_id; a new scene
    forgets the tracks. ``recognise(row)`` names a track that has no label yet and gives its similarity.
    Rows are shuffled by key and sorted; a task holds one batch, the rows of one frame and one key's tracks.
    """
    ready(detections.sparkSession)
    kind = detections.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, frame_idx int, det_ord int, track_id int, label string, sim double"
    corners = ("_x1", "_y1", "_x2", "_y2")
    more = [c for c in detections.columns if c not in (key, "frame_idx", "det_ord", "box", "scene_id") and recognise]
    scene = ["scene_id"] if "scene_id" in detections.columns else []
    ints = [F.col(c).cast("int").alias(c) for c in ("frame_idx", "det_ord")]
    rows = detections.select(key, *ints, *scene, *more, *(F.get("box", F.lit(k)).cast("double").alias(c) for k, c in enumerate(corners)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, left = _Frames(threshold, max_age, recognise), None

        def done(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
            columns = {c: batch.column(c).to_pylist() for c in (key, "frame_idx", "det_ord", *scene, *more)}
            x1, y1, x2, y2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in corners)
            boxes = np.stack([x1, y1, x2, y2, (x2 - x1) * (y2 - y1)], 1).tolist()
            places, found = state.run(columns[key], columns["frame_idx"], columns["scene_id"] if scene else None, boxes, ends, lambda k: {c: x[k] for c, x in columns.items()})
            at = pa.array(places, pa.int64())
            numbers, labels, sims = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (key, "frame_idx", "det_ord")), pa.array(numbers, pa.int32()), pa.array(labels, pa.string()), pa.array(sims, pa.float64())], [key, "frame_idx", "det_ord", "track_id", "label", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if left is None else pa.concat_batches([left, batch])
            same = np.ones(batch.num_rows - 1, bool)
            for c in (key, "frame_idx"):
                x = batch.column(c)
                same &= pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(x[1:]).to_numpy(zero_copy_only=False) & pc.is_null(x[:-1]).to_numpy(zero_copy_only=False))
            ends = (np.flatnonzero(~same) + 1).tolist()
            # The last frame may go on in the next batch.
            left = batch.slice(ends[-1]) if ends else batch
            if ends:
                yield done(batch.slice(0, ends[-1]), ends)
        if left is not None:
            yield done(left, [left.num_rows])

    return rows.repartition(key).sortWithinPartitions(key, "frame_idx", "det_ord").mapInArrow(run, schema)


def sticky_labels(tracks: DataFrame, key: str = "video") -> DataFrame:
    """Adds the first label that a track was given up to each frame."""
    by = W.partitionBy(key, "track_id").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    return tracks.withColumn("sticky_label", F.first("label", ignorenulls=True).over(by))


def stale(tracks: DataFrame, now: int, max_age: int, key: str = "video") -> DataFrame:
    """Tracks last seen more than ``max_age`` frames before ``now``."""
    return tracks.groupBy(key, "track_id").agg(F.max("frame_idx").alias("last_frame")).where(F.lit(now) - F.col("last_frame") > max_age)


# Weights of the five points.
WEIGHTS = np.array([0.45, 0.45, 0.55, 0.65, 0.65])[:, None]


def damped_points(before: np.ndarray, now: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The next smoothed points: first the size of the eye-nose triangle is held, then each point's step.

    Points are (..., 5, 2) and boxes (..., 4).
    """
    def anchor(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = (((p[..., 0, :] + p[..., 1, :]) / 2 + p[..., 2, :]) / 2)[..., None, :]
        return middle, np.sqrt(((p[..., :3, :] - middle) ** 2).sum(-1).mean(-1))

    box = np.asarray(box, np.float64)
    (_, old), (centre, size) = anchor(before), anchor(now)
    eyes = np.linalg.norm(now[..., 1, :] - now[..., 0, :], axis=-1)
    face = np.maximum(np.maximum(box[..., 2] - box[..., 0], box[..., 3] - box[..., 1]), np.maximum(2.5 * eyes, 1.0))
    reach = np.minimum(np.maximum(3.0 / face, 0.010), 0.028)
    held = np.minimum(np.maximum(size, old * (1 - reach)), old * (1 + reach))
    sized = np.minimum(old, size) > 1e-6
    scale = np.where(sized, (old + 0.35 * (held - old)) / np.where(sized, size, 1.0), 1.0)[..., None, None]
    step = np.where(sized[..., None, None], centre + (now - centre) * scale, now) - before
    length = np.linalg.norm(step, axis=-1, keepdims=True)
    step = step * np.minimum(1.0, np.maximum(1.5, 0.08 * face)[..., None, None] / np.maximum(length, 1e-6))
    return before + step * WEIGHTS


def _boxes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("box").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)


def damped_landmarks(tracks: DataFrame, keys: tuple[str, ...] = ("video", "track_id")) -> DataFrame:
    """(keys, frame_idx, points): five-point landmarks damped along each track; a gap starts anew."""
    def out(x: np.ndarray) -> pa.Array:
        pairs = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 2, dtype=np.int32), pa.array(x.ravel()))
        return pa.ListArray.from_arrays(np.arange(0, x.size // 2 + 1, 5, dtype=np.int32), pairs)

    kinds = ", ".join(f"{k} {tracks.schema[k].dataType.simpleString()}" for k in keys)
    rows = tracks.where("points is not null").select(*keys, F.col("frame_idx").cast("int").alias("frame_idx"), F.col("box").cast("array<double>").alias("box"), F.col("points").cast("array<array<double>>").alias("points"))
    points = lambda b: b.column("points").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 5, 2)
    got = run_fold(rows, keys, "frame_idx", points, lambda old, now, b: damped_points(old, now, _boxes(b)), out, f"{kinds}, frame_idx int, value array<array<double>>")
    return got.withColumnRenamed("value", "points")


def clipped(box: np.ndarray, width: int, height: int) -> np.ndarray:
    """Boxes (..., 4) inside the frame, at least two pixels wide and high, rounded outward."""
    size = np.array([width, height], np.float64)
    low = np.minimum(np.maximum(box[..., :2], 0.0), np.maximum(size - 2, 0))
    high = np.minimum(np.maximum(box[..., 2:], low + 2), size)
    return np.concatenate([np.floor(low), np.ceil(high)], -1)


def steady_box(before: np.ndarray, now: np.ndarray, width: int, height: int) -> np.ndarray:
    """The next steady box: the centre moves by a bounded step, the size follows slowly."""
    size, new_size = before[..., 2:] - before[..., :2], now[..., 2:] - now[..., :2]
    reach = np.maximum(0.08 * size, 2.0)
    centre = (before[..., :2] + before[..., 2:]) / 2
    centre = centre + np.clip((now[..., :2] + now[..., 2:]) / 2 - centre, -reach, reach)
    half = (0.65 * size + 0.35 * new_size) / 2
    return clipped(np.concatenate([centre - half, centre + half], -1), width, height)


def steady_boxes(tracks: DataFrame, width: int, height: int, keys: tuple[str, ...] = ("video", "track_id")) -> DataFrame:
    """(keys, frame_idx, box): boxes whose centre moves little and whose size follows slowly; a gap starts anew."""
    kinds = ", ".join(f"{k} {tracks.schema[k].dataType.simpleString()}" for k in keys)
    rows = tracks.select(*keys, F.col("frame_idx").cast("int").alias("frame_idx"), F.col("box").cast("array<double>").alias("box"))
    out = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, 4, dtype=np.int32), pa.array(x.ravel().astype(np.int32)))
    got = run_fold(rows, keys, "frame_idx", _boxes, lambda old, now, b: steady_box(old, now, width, height), out, f"{kinds}, frame_idx int, value array<int>")
    return got.withColumnRenamed("value", "box")


def overlap_gate(tracks: DataFrame, least: float = 0.35, keys: tuple[str, ...] = ("video", "track_id")) -> DataFrame:
    """Adds share (overlap with the box before over this box's area) and blends (share >= least)."""
    by = W.partitionBy(*keys).orderBy("frame_idx")
    at = lambda c, k: F.get(F.col(c), F.lit(k)).cast("double")
    df = tracks.withColumn("_p", F.lag("box").over(by))
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(at("box", b), at("_p", b)) - F.greatest(at("box", a), at("_p", a)))
    area = (at("box", 2) - at("box", 0)) * (at("box", 3) - at("box", 1))
    df = df.withColumn("share", F.when(F.col("_p").isNotNull() & (area > 0), side(0, 2) * side(1, 3) / area).otherwise(F.lit(0.0))).drop("_p")
    return df.withColumn("blends", F.col("share") >= least)
