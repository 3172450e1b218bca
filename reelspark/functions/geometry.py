"""Boxes, landmarks and quality scores as expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Toward zero, as an int."""
    return x.cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def margin_rect(top: Column, right: Column, bottom: Column, left: Column, ratio: float, width: Column, height: Column, least: int | None = None) -> list[Column]:
    """top, left, bottom, right of a box with a margin of its own size, inside the frame."""
    h, w = bottom - top, right - left
    if least is not None:
        h, w = F.greatest(h, F.lit(least)), F.greatest(w, F.lit(least))
    mh, mw = whole(h * F.lit(ratio)), whole(w * F.lit(ratio))
    return [F.greatest(F.lit(0), top - mh), F.greatest(F.lit(0), left - mw), F.least(height, bottom + mh), F.least(width, right + mw)]


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.5) -> list[Column]:
    px, py = (x2 - x1) * F.lit(pad), (y2 - y1) * F.lit(pad)
    return [F.greatest(F.lit(0), whole(x1 - px)), F.greatest(F.lit(0), whole(y1 - py)), F.least(width, whole(x2 + px)), F.least(height, whole(y2 + py))]


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """The box inside the frame, at least two pixels wide and high, rounded outward."""
    def one(a: Column, b: Column, size: Column) -> tuple[Column, Column]:
        a = F.least(F.greatest(a, F.lit(0.0)), F.greatest(size - 2, F.lit(0)).cast("double"))
        return a, F.least(F.greatest(b, a + 2), size.cast("double"))

    (x1, x2), (y1, y2) = one(x1, x2, width), one(y1, y2, height)
    return [whole(F.floor(x1)), whole(F.floor(y1)), whole(F.ceil(x2)), whole(F.ceil(y2))]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two (x1, y1, x2, y2) boxes over their union; 0 without one."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0)))


def eye_aspect_ratio(points: Column) -> Column:
    """Height over width of an eye of six points; 0 if there are fewer or it has no width."""
    def ratio(points: Column) -> Column:
        p = [F.get(points, F.lit(k)) for k in range(6)]
        return bound(distance(p[0], p[3]), lambda width: F.when((F.size(points) >= 6) & (width >= 1e-6), (distance(p[1], p[5]) + distance(p[2], p[4])) / (2 * width)).otherwise(F.lit(0.0)))

    return bound(points, ratio)


def _middle(points: Column) -> Column:
    return F.get(points, (F.size(points) / 2).cast("int"))


def _centre(points: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(points, zero, lambda s, p: F.struct((s["x"] + p["x"].cast("double")).alias("x"), (s["y"] + p["y"].cast("double")).alias("y")))
    return bound(total, lambda s: F.struct((s["x"] / F.size(points)).alias("x"), (s["y"] / F.size(points)).alias("y")))


def frontality(landmarks: Column) -> Column:
    """0 (profile) to 1 (frontal) by the nose's place between the eyes and above the chin."""
    def score(m: Column) -> Column:
        return F.when((m["far"] >= 1e-6) & (m["height"] >= 1e-6), clip(m["near"] / m["far"] * 0.7 + F.greatest(1 - F.least(F.abs(m["drop"] / m["height"] - 0.4) * 3, F.lit(1.0)), F.lit(0.0)) * 0.3, 0, 1)).otherwise(F.lit(0.0))

    def measured(p: Column) -> Column:
        a, b, middle = distance(p["tip"], p["left"]), distance(p["tip"], p["right"]), (p["left"]["y"] + p["right"]["y"]) / 2
        return bound(F.struct(F.greatest(a, b).alias("far"), F.least(a, b).alias("near"), (p["low"]["y"] - middle).alias("height"), (p["tip"]["y"] - middle).alias("drop")), score)

    def of(marks: Column) -> Column:
        nose, left, right, chin = (marks[k] for k in ("nose_tip", "left_eye", "right_eye", "chin"))
        there = F.coalesce(F.size(nose), F.lit(0)) > 0
        for x in (left, right, chin):
            there = there & (F.coalesce(F.size(x), F.lit(0)) > 0)
        points = F.struct(_middle(nose).alias("tip"), _middle(chin).alias("low"), bound(left, _centre).alias("left"), bound(right, _centre).alias("right"))
        return F.when(there, bound(points, measured)).otherwise(F.lit(0.0))

    return bound(landmarks, of)


def eye_ratios(eyes: np.ndarray) -> np.ndarray:
    """``eye_aspect_ratio`` of many eyes at once, (n, 6, 2)."""
    gap = lambda a, b: np.sqrt(((eyes[:, a] - eyes[:, b]) ** 2).sum(-1))
    width = gap(0, 3)
    there = width >= 1e-6
    return np.where(there, (gap(1, 5) + gap(2, 4)) / np.where(there, 2 * width, 1.0), 0.0)


def frontalities(nose: np.ndarray, left: np.ndarray, right: np.ndarray, chin: np.ndarray) -> np.ndarray:
    """``frontality`` of many faces at once; each group of landmarks is (n, its points, 2), with a point at least."""
    tip, low = (x[:, x.shape[1] // 2] for x in (nose, chin))
    left, right = left.mean(1), right.mean(1)
    a, b = (np.sqrt(((tip - x) ** 2).sum(-1)) for x in (left, right))
    middle = (left[:, 1] + right[:, 1]) / 2
    far, near, height, drop = np.maximum(a, b), np.minimum(a, b), low[:, 1] - middle, tip[:, 1] - middle
    there = (far >= 1e-6) & (height >= 1e-6)
    far, height = np.where(there, far, 1.0), np.where(there, height, 1.0)
    score = near / far * 0.7 + np.maximum(1 - np.minimum(np.abs(drop / height - 0.4) * 3, 1.0), 0.0) * 0.3
    return np.where(there, np.clip(score, 0.0, 1.0), 0.0)


def sharpness(laplacian_variance: Column) -> Column:
    return clip(laplacian_variance / 500, 0, 1)


def lighting(mean: Column, std: Column) -> Column:
    bright = F.when(mean < 40, mean / 40).when(mean > 220, F.greatest(F.lit(0.0), (255 - mean) / 35)).otherwise(F.lit(1.0))
    return clip(bright * 0.6 + clip(std / 50, 0, 1) * 0.4, 0, 1)


def face_fill(top: Column, right: Column, bottom: Column, left: Column, height: Column, width: Column) -> Column:
    frame = height * width
    return F.when(frame > 0, clip((bottom - top) * (right - left) / frame / 0.15, 0, 1)).otherwise(F.lit(0.0))


def reference_score(faces: Column, fill: Column, sharp: Column, light: Column, landmarks: Column | None = None) -> Column:
    """The composite quality of a face; 0 unless it is alone in its frame."""
    plain = clip(fill * 0.30 + sharp * 0.35 + light * 0.35, 0, 1)
    if landmarks is None:
        return F.when(faces == 1, plain).otherwise(F.lit(0.0))
    none = F.array().cast("array<struct<x:int,y:int>>")

    def full(marks: Column) -> Column:
        ear = (eye_aspect_ratio(F.coalesce(marks["left_eye"], none)) + eye_aspect_ratio(F.coalesce(marks["right_eye"], none))) / 2
        return marked_score(frontality(marks), ear, fill, sharp, light)

    return F.when(faces != 1, F.lit(0.0)).when(landmarks.isNull(), plain).otherwise(bound(landmarks, full))


def marked_score(frontal: Column, ear: Column, fill: Column, sharp: Column, light: Column) -> Column:
    """The composite quality of a face with landmarks."""
    eyes = clip((ear - 0.15) / 0.15, 0, 1)
    return clip(frontal * 0.30 + eyes * 0.20 + fill * 0.15 + sharp * 0.20 + light * 0.15, 0, 1)


def wears_glasses(vertical: Column, canny: Column, bridge: Column) -> Column:
    """Whether the edges around the eyes and on the bridge of the nose look like a pair of glasses."""
    return ((vertical > 0.28) & (canny > 0.23)) | ((bridge > 0.33) & (canny > 0.20))


def roi(points: Column, box: list[Column], width: Column, height: Column) -> list[Column]:
    """Centre and size of a region: the padded box's size around a blend of the landmarks' middle and the box's."""
    x, y = (lambda k: F.get(F.get(points, F.lit(k)), F.lit(0))), (lambda k: F.get(F.get(points, F.lit(k)), F.lit(1)))
    x1, y1, x2, y2 = padded_box(*box, width, height)
    w, h = F.greatest((x2 - x1).cast("double"), F.lit(2.0)), F.greatest((y2 - y1).cast("double"), F.lit(2.0))
    mid_x = sum((x(k) for k in range(1, 5)), x(0)) / 5
    mid_y = ((y(0) + y(1)) / 2 + (y(3) + y(4)) / 2) / 2 + h * 0.08
    return [mid_x * 0.65 + (box[0] + box[2]) / 2 * 0.35, mid_y * 0.65 + (box[1] + box[3]) / 2 * 0.35, w, h]


def duration(frames: Column, fps: Column) -> Column:
    """Seconds of a video; 0 without a rate."""
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))
