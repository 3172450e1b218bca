"""Quality scores from random-indexing word vectors and a small neural network.

Words are runs of letters, of digits or of other signs, in their own case. Each falls into one of
``BUCKETS`` buckets, and each bucket has a fixed sparse ternary index vector. A bucket's word vector
is the sum of the index vectors of all neighbours that its words have in the whole corpus, in
integers, so the sum does not depend on the order of rows. A document is the mean of its words'
unit vectors. A network with one hidden layer learns the label from a bounded sample of the labelled
rows; a part of the sample that it has not seen fits the temperature of its probabilities.

Defined results: a null or empty text has the zero vector and its score; without labels of both
kinds every score is the labels' mean, or 0.5; null labels are left out and of a document's
different labels the smallest counts; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm import kernels
from reelspark.llm.shared import crc32_of, free, summed
from reelspark.session import ready

BUCKETS, DIMENSIONS, ONES, WINDOW = 1 << 14, 64, 4, 2
#: Most labelled rows that the network is fitted on.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH = 32, 40, 128

CLASSES = np.full(256, 3, np.uint8)
CLASSES[kernels.SPACE == 1] = 0
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[48:58] = 2


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    h = kernels.mix(np.arange(BUCKETS * ONES, dtype=np.uint64), 77).reshape(BUCKETS, ONES)
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), 1 - 2 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.int64)


def _tokens(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of each word, its row) for chunks of rows."""
    for first, end, data, offsets in kernels.chunks(text):
        a, b, row = kernels.words(data, offsets, CLASSES)
        yield first, end, (kernels.word_hashes(data, a, b) % np.uint64(BUCKETS)).astype(np.int64), row


def _fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
    place, sign = _index_vectors()
    for _, _, b, row in _tokens(batch.column(0)):
        for step in range(1, WINDOW + 1):
            same = row[step:] == row[:-step]
            left, right = b[:-step][same], b[step:][same]
            word, near = np.concatenate([left, right]), np.concatenate([right, left])
            at = (word * DIMENSIONS)[:, None] + place[near]
            table += np.bincount(at.ravel(), sign[near].ravel(), len(table)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector for each bucket, from all texts of the one column of ``docs``."""
    x = summed(docs, _fill, BUCKETS * DIMENSIONS).reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1)[:, None]
    used = np.any(x != 0, axis=1)
    if used.any():
        x[used] -= x[used].mean(0)
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)


def pooled(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text."""
    out = np.zeros((len(text), vectors.shape[1]), np.float64)
    for first, end, b, row in _tokens(text):
        n = np.bincount(row, minlength=end - first)
        full = np.flatnonzero(n)
        if len(full):
            starts = np.searchsorted(row, full)
            for k in range(0, len(full), 512):  # keeps the gathered vectors small
                a, z = starts[k], starts[k + 512] if k + 512 < len(full) else len(b)
                out[first + full[k : k + 512]] = np.add.reduceat(vectors[b[a:z]], starts[k : k + 512] - a, axis=0)
            out[first + full] /= n[full][:, None]
    return out


def _forward(x: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"])
    return hidden, hidden @ net["w2"] + net["b2"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """The network, its temperature included."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    check, train = order[: len(x) // 5], order[len(x) // 5 :]
    net = {"mean": x[train].mean(0), "scale": x[train].std(0) + 1e-6, "w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(())}
    names = ("w1", "b1", "w2", "b2")
    moved = {k: (np.zeros_like(net[k]), np.zeros_like(net[k])) for k in names}
    t = 0
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        rate = 0.01 * (1 - epoch / EPOCHS)
        for at in range(0, len(train), BATCH):
            k = train[at : at + BATCH]
            hidden, logit = _forward(x[k], net)
            d = (_sigmoid(logit) - y[k]) / len(k)
            dh = np.outer(d, net["w2"]) * (1 - hidden**2)
            step = {"w1": ((x[k] - net["mean"]) / net["scale"]).T @ dh + 1e-4 * net["w1"], "b1": dh.sum(0), "w2": hidden.T @ d + 1e-4 * net["w2"], "b2": d.sum()}
            t += 1
            for n in names:
                m, v = moved[n]
                m, v = 0.9 * m + 0.1 * step[n], 0.999 * v + 0.001 * step[n] ** 2
                moved[n] = m, v
                net[n] = net[n] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    logit, temperatures = _forward(x[check], net)[1], np.exp(np.linspace(-2, 3, 101))
    loss = [np.mean(np.logaddexp(0, logit / c) - y[check] * logit / c) if len(check) else (c - 1) ** 2 for c in temperatures]
    return net | {"temperature": float(temperatures[int(np.argmin(loss))])}


def predict(x: np.ndarray, net: dict) -> np.ndarray:
    return _sigmoid(_forward(x, net)[1] / net["temperature"]) if "w1" in net else np.full(len(x), net["prior"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """(doc_id, y) of at most ``sample`` labelled ones of ``docs`` outside the held-out fold, chosen by hash."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(F.pmod(crc32_of("doc_id"), F.lit(5)) != 0)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("y"))
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def one_row_each(rows: DataFrame) -> list:
    """(doc_id, y, x) in order of id; of a document's different texts the one whose x is smallest."""
    return sorted(rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect())


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> dict:
    """The network for ``labels.quality``, from at most ``sample`` rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), vectors)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    chosen = F.broadcast(labelled(docs, labels, "quality", sample))  # at most ``sample`` rows
    rows = docs.join(chosen, "doc_id").select("doc_id", F.col("y").cast("long").alias("y"), "text").mapInArrow(run, "doc_id long, y long, x binary")
    rows = one_row_each(rows)
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return {"prior": float(y.mean()) if len(y) else 0.5}
    return fit(np.stack([np.frombuffer(r["x"], np.float64) for r in rows]), (y > 0).astype(np.float64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``keep``: columns of ``docs`` to return before these, instead of the id."""
    ready(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vectors = word_vectors(slim.select("text"))
    net = train(slim, labels, vectors, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = predict(pooled(batch.column(batch.num_columns - 1), vectors), net)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    if keep is None:
        rows = slim.withColumn("held_out", F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(5)) == 0, F.lit(False))).select("doc_id", "held_out", "text")
        rows = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    else:
        rows = docs.select(*keep, F.col(text_col).alias(*free(docs, "text")))
        rows = rows.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
