"""Spark helpers of the operators here: summed tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import cut, ready

#: Slices of a summed table; each is one small binary row.
SLICES = 64
#: Edges whose components one task finds: 16 bytes each.
ONE_TASK = 500_000


def summed(df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], length: int, reduce: np.ufunc = np.add, least: int | None = None) -> np.ndarray:
    """A table of ``length`` 64-bit integers, filled from every row of ``df`` and reduced over tasks.

    ``fill(batch, table)`` adds a batch to its task's table. Each task sends its table once, in
    slices; each slice is reduced while it streams by, so no task holds more than its own slices.
    The driver receives ``length`` numbers, whatever the size of ``df``; with ``least`` it receives a
    bit for each, and the table says which numbers are that large.
    """
    per = -(-length // SLICES)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = np.zeros(per * SLICES, np.int64) if total is None else total
                fill(batch, total)
        if total is not None:
            for k in range(SLICES):
                piece = total[k * per : (k + 1) * per]
                if piece.any():
                    at = np.flatnonzero(piece)
                    small = piece.astype(np.int32) if -(2**31) <= piece.min() and piece.max() < 2**31 else piece
                    dense = len(at) * 3 > per
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "at": pa.array([None if dense else at.astype(np.int32).tobytes()], pa.binary()), "wide": pa.array([small.dtype == np.int64]), "data": pa.array([(small if dense else small[at]).tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], np.int64 if row["wide"] else np.int32)
                x = total.setdefault(row["slice"], np.zeros(per, np.int64))
                if row["at"] is None:
                    reduce(x, data, out=x)
                else:
                    at = np.frombuffer(row["at"], np.int32)
                    x[at] = reduce(x[at], data)
        for k, x in total.items():
            if least is not None:
                x = np.packbits(x >= least)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(per * SLICES, np.int64) if least is None else np.full(per * SLICES, least <= 0)
    pieces = df.mapInArrow(part, "slice int, at binary, wide boolean, data binary").repartition("slice").mapInArrow(merge, "slice int, data binary")
    for row in pieces.collect():
        data = np.frombuffer(row["data"], np.int64) if least is None else np.unpackbits(np.frombuffer(row["data"], np.uint8), count=per)
        out[row["slice"] * per : (row["slice"] + 1) * per] = data
    return out[:length]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of an edge list but the smallest ones."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a].copy(), low)
        np.minimum.at(label, label[b].copy(), low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label[label], label):
            label = label[label]
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep a spanning forest of the edges seen, at a bounded number of edges at a time."""
    u, v, n = [], [], 0

    def out() -> pa.RecordBatch:
        a, b = forest(np.concatenate(u), np.concatenate(v))
        return pa.RecordBatch.from_pydict({"u": a, "v": b})

    for batch in batches:
        if batch.num_rows:
            u.append(batch.column(0).to_numpy(zero_copy_only=False))
            v.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n > 1_000_000:
                yield out()
                u, v, n = [], [], 0
    if n:
        yield out()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges seen."""
    edges = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if edges:
        node, component = forest(*map(np.concatenate, zip(*edges, strict=True)))
        roots = np.unique(component)
        yield pa.RecordBatch.from_pydict({"node": np.concatenate([node, roots]), "component": np.concatenate([component, roots])})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of the edges (u, v), both long; component is the smallest node.

    Large-star and small-star rounds, each a few joins on the nodes, until the edges stay the same.
    Edges that are few enough for one task, by count, need no rounds. Nodes without an edge are not listed.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.select("u", "v").where(u != v).mapInArrow(_local, "u long, v long")
    edges = cut(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    if edges.count() <= ONE_TASK:
        return edges.repartition(1).mapInArrow(_whole, "node long, component long")
    before = None
    while True:
        sizes = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sizes == before or not sizes[0]:
            break
        before = sizes
        both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min(F.least(u, v)).alias("m"))
        large = edges.select(v.alias("u"), u.alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").unionAll(edges.select(v.alias("node"), v.alias("component")).distinct())


class Shelf:
    """Intermediate tables of one operator: Parquet in a folder of its own under the shared checkpoint folder.

    Unlike checkpoints they are compressed, read column by column and can be dropped when they are done with.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = ready(spark), {}
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and go on from the written copy."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        for path, table in self.paths.items():
            if any(table is x for x in tables):
                path_of(path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path_of(path), True)

    def close(self, result: DataFrame) -> DataFrame:
        """Write the result and remove everything else."""
        result = self.keep(result)
        self.drop(*(x for x in self.paths.values() if x is not result))
        return result


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, written, with a broadcast hint if it has at most ``rows`` rows, else a hint to hash it in a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df``."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        out.append(name)
    return out


def crc32_of(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
