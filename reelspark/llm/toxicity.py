"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the distinct lower-case words of a text and their leading stems, hashed into ``FEATURES`` places.
All thresholds share one weight vector: P(grade > k) = sigmoid(w x - c_k) with c_1 < c_2 < ...
The label table says only whether a document is toxic; the grades of the toxic ones are bands of how
much of their text consists of words typical of toxic documents, judged on the same sample. The
results are the probability of each grade, the expected severity (0 to the highest grade) and the
flag that the document is toxic at all.

Defined results: a null or empty text has no features and the score of the thresholds alone; without
labels of both kinds the score is the labels' mean, or 0; null labels are left out; repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import kernels
from reelspark.llm.quality import labelled, one_row_each
from reelspark.llm.shared import crc32_of
from reelspark.session import ready

FEATURES = 1 << 18
GRADES = 3
#: Most labelled rows that the regression is fitted on.
SAMPLE = 12_000
#: The ridge was chosen by cross-validation on learning rows.
STEPS, RIDGE = 200, 3e-3
#: Byte lengths of the stems that longer words have as features, and the rows that a feature has to be in to get a weight.
STEMS = (4, 5, 6, 7)
LEAST_ROWS = 4

CLASSES = np.zeros(256, np.uint8)
CLASSES[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct features) of every text."""
    for first, end, data, offsets in kernels.chunks(text):
        data = kernels.lowered(data)
        a, b, row = kernels.words(data, offsets, CLASSES)
        kinds = [kernels.word_hashes(data, a, b) % np.uint64(FEATURES)]
        for k in STEMS:
            long = b - a > k
            kinds.append(np.full(len(a), FEATURES, np.uint64))
            kinds[-1][long] = kernels.mix(kernels.word_hashes(data, a[long], a[long] + k), k) % np.uint64(FEATURES)
        kinds = np.stack(kinds).astype(np.int32)
        bounds = np.searchsorted(row, np.arange(end - first + 1))
        for i in range(end - first):
            x = np.unique(kinds[:, bounds[i] : bounds[i + 1]])
            yield first + i, x[: np.searchsorted(x, FEATURES)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic ones by thirds of the share of their features that are typical of toxic rows."""
    bad = np.bincount(np.concatenate([x for x, t in zip(rows, toxic, strict=True) if t]), minlength=FEATURES)
    good = np.bincount(np.concatenate([x for x, t in zip(rows, toxic, strict=True) if not t]), minlength=FEATURES)
    odds = np.log((bad + 0.5) / toxic.sum()) - np.log((good + 0.5) / (~toxic).sum())
    typical = (odds > 2) & (bad >= 3)
    share = np.array([typical[x].mean() if len(x) else 0.0 for x in rows])
    bands = np.quantile(share[toxic], [k / GRADES for k in range(1, GRADES)])
    return np.where(toxic, 1 + (share[:, None] > bands).sum(1), 0)


def likelihood(s: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades y at scores s, and its slopes by s and by the thresholds.

    The likelihood of grade k is P(> k - 1) - P(> k).
    """
    p = _sigmoid(s[:, None] - cuts)
    ones, zeros, k = np.ones((len(s), 1)), np.zeros((len(s), 1)), np.arange(len(s))
    chance = np.maximum((np.concatenate([ones, p], 1) - np.concatenate([p, zeros], 1))[k, y], 1e-9)
    slope = p * (1 - p)
    du, dl = np.concatenate([zeros, slope], 1)[k, y], np.concatenate([slope, zeros], 1)[k, y]
    dc = np.zeros(len(cuts) + 2)
    np.add.at(dc, y, du / chance / len(s))
    np.add.at(dc, y + 1, -dl / chance / len(s))
    return float(-np.log(chance).mean()), -(du - dl) / chance / len(s), dc[1:-1]


def _grouped(values: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[index] over consecutive groups, none of them empty; about a million entries at a time."""
    out, ends, k = np.zeros(len(starts)), np.append(starts[1:], len(index)), 0
    while k < len(starts):
        z = max(k + 1, int(np.searchsorted(ends, starts[k] + 1_000_000, "right")))
        out[k:z] = np.add.reduceat(values[index[starts[k] : ends[z - 1]]], starts[k:z] - starts[k])
        k = z
    return out


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """Weights shared by all thresholds, and the thresholds."""
    counts = np.zeros(FEATURES, np.int64)
    for x in rows:
        counts[x] += 1
    used = np.flatnonzero(counts >= LEAST_ROWS)
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used))
    # The known features of each row, and the rows of each known feature: 4 bytes an entry each.
    known = [p[p >= 0] for p in (place[x] for x in rows)]
    sizes = np.array([len(x) for x in known])
    full, starts = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
    at = np.concatenate([*known, np.zeros(0, np.int32)])
    del known
    of = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[np.argsort(at, kind="stable")]
    firsts = np.cumsum(counts[used]) - counts[used]
    above = np.stack([(y > k) for k in range(GRADES)], 1).astype(np.float64)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    w, c = np.zeros(len(used)), np.sort(-np.log(share / (1 - share)))
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)
    for t in range(1, STEPS + 1):
        s = np.zeros(len(rows))
        s[full] = _grouped(w, at, starts)
        _, ds, dc = likelihood(s, c, y)
        gw, gc = _grouped(ds, of, firsts) + RIDGE * w, dc
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc**2
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        rate = 0.05 * (1 - (t - 1) / STEPS)  # without the fall, the last steps swing and magnify rounding
        w = w - rate * fix * m / (np.sqrt(v) + 1e-9)
        c = np.sort(c - rate * fix * mc / (np.sqrt(vc) + 1e-9))
        c[1:] = np.maximum(c[1:], c[:-1] + 1e-3)
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = w
    return {"weights": weights, "cuts": c}


def _train(docs: DataFrame, labels: DataFrame, sample: int) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [f.tobytes() for _, f in features(batch.column(2))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "x": pa.array(x, pa.binary())})

    chosen = F.broadcast(labelled(docs, labels, "toxic", sample))  # at most ``sample`` rows
    rows = docs.join(chosen, "doc_id").select("doc_id", F.col("y").cast("long").alias("y"), "text").mapInArrow(run, "doc_id long, y long, x binary")
    rows = one_row_each(rows)
    toxic = np.array([r["y"] > 0 for r in rows], bool)
    if len(set(toxic.tolist())) < 2:
        return {"prior": float(toxic.mean()) if len(rows) else 0.0}
    x = [np.frombuffer(r["x"], np.int32) for r in rows]
    return fit(x, grades(x, toxic))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, grade, expected_severity) of every row.

    score: P(grade > 0); predicted: 1 from ``threshold`` on; grade: the likeliest one.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    net = _train(slim, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "weights" in net:
                s = np.array([net["weights"][x].sum(dtype=np.float64) for _, x in features(batch.column(2))])
                p = _sigmoid(s[:, None] - net["cuts"])
            else:
                p = np.tile(np.array([net["prior"], *[0.0] * (GRADES - 1)]), (batch.num_rows, 1))
            each = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": p[:, 0], "predicted": pa.array(p[:, 0] >= threshold).cast(pa.int32()), "grade": pa.array(each.argmax(1), pa.int32()), "expected_severity": p.sum(1)})

    held = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(5)) == 0, F.lit(False))
    return slim.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, grade int, expected_severity double")
