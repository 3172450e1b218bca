"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of all vectors, largest variance first, and sorted
into tiles along the leading ones. A pair of tiles is skipped when the boxes of its leading
coordinates lie too far apart. Elsewhere inner products are accumulated over the leading dimensions
first, ``LEAD`` at a time; what the other dimensions can still add is bounded by the product of the
suffix norms, and after each step only pairs that can yet reach the threshold go on. Those left at the
end are decided by the cosine of the vectors as given, in double precision. Pairs of tiles are compared
by squares of ``SIDE`` tiles a side, so a tile is sent once for a square and not for each of its pairs.

Equal vectors are one row with a count. A pair of tiles gives link counts and a spanning forest of
its links, never the links themselves, so a large group of near copies costs no more rows than it has
members.

Vectors of different lengths have no cosine, so each length is a comparison of its own.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links
with nothing; repeated rows link with each other; a row with a null id counts as a link of others but has no component of its own. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from reelspark.llm.shared import components, forest
from reelspark.session import cut, ready

#: Vectors in a tile and their components, rows of a tile compared at once, and the leading dimensions.
TILE = 4096
VALUES = 1 << 18
STRIP = 256
LEAD = 16
#: Tiles on a side of a square of pairs that one task compares.
SIDE = 4
#: Width of the cells of the leading coordinates.
CELL = 0.4
#: The rounding that a rotated product may carry.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False))


def _moments(size: int):
    """A task's sum of outer products of unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _units(_matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"data": pa.array([total.tobytes()], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            x = np.frombuffer(x, np.float64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"data": pa.array([total.tobytes()], pa.binary())})


def _norms(x: np.ndarray) -> np.ndarray:
    """Row norms that neither overflow nor vanish."""
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / _norms(x)[:, None]


def _placed(axes: np.ndarray):
    """Cells of the leading coordinates, by which rows are sorted into tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = _units(_matrix(batch.column(1))) @ axes[:, :3]
                cells = np.zeros((3, len(turned)), np.int32)
                cells[: turned.shape[1]] = np.floor(turned / CELL).T
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells), pa.array(turned[:, 0])], ["node", "e", "copies", "c1", "c2", "c3", "lead"])

    return run


def _packed(tile: int, axes: np.ndarray):
    """A tile as one row: its rows' bytes, and the box of their leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, k = 0, 0

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal k
            raw = _matrix(t.column("e").combine_chunks())
            turned = _units(raw) @ axes[:, :LEAD]
            k += 1
            return pa.RecordBatch.from_pydict({
                "tile": pa.array([(_task() << 32) + k], pa.int64()),
                "low": pa.array([turned.min(0)], pa.list_(pa.float64())),
                "high": pa.array([turned.max(0)], pa.list_(pa.float64())),
                "nodes": pa.array([t.column("node").to_numpy().tobytes()], pa.binary()),
                "copies": pa.array([t.column("copies").to_numpy().tobytes()], pa.binary()),
                "raw": pa.array([raw.tobytes()], pa.binary()),
            })

        for batch in batches:
            batch = batch.select(["node", "e", "copies"])
            while batch.num_rows:
                part = batch.slice(0, tile - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == tile:
                    yield out(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield out(pa.Table.from_batches(held))

    return run


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _compared(threshold: float, size: int, kind: type, axes: np.ndarray):
    """Counts and a forest of the links of pairs of tiles."""

    def opened(x: dict) -> dict:
        unit = _units(np.frombuffer(x["raw"], kind).reshape(-1, size))
        turned = unit @ axes
        # The norms of what is left of each vector after each step.
        tails = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.stack([np.sqrt(tails[:, k]) if k < size else np.zeros(len(unit)) for k in [*range(LEAD, size, LEAD), size]], axis=1)
        return {"nodes": np.frombuffer(x["nodes"], np.int64), "copies": np.frombuffer(x["copies"], np.int64), "unit": unit, "turned": turned, "rest": rest}

    def links(one: dict, two: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        steps = [*range(LEAD, size, LEAD), size]
        p, q = one["turned"], two["turned"]
        for at in range(0, len(p), STRIP):
            reach = p[at : at + STRIP, : steps[0]] @ q[:, : steps[0]].T
            i, j = np.nonzero(reach + one["rest"][at : at + STRIP, :1] * two["rest"][:, 0] >= threshold - SLACK)
            if same:
                i, j = i[j > i + at], j[j > i + at]
            for k in range(0, len(i), 65_536):
                a, b = i[k : k + 65_536], j[k : k + 65_536]
                so_far, a = reach[a, b], a + at
                for n in range(1, len(steps)):
                    so_far += (p[a, steps[n - 1] : steps[n]] * q[b, steps[n - 1] : steps[n]]).sum(1)
                    go = so_far + one["rest"][a, n] * two["rest"][b, n] >= threshold - SLACK
                    a, b, so_far = a[go], b[go], so_far[go]
                hit = (one["unit"][a] * two["unit"][b]).sum(1) >= threshold
                if hit.any():
                    yield a[hit], b[hit]

    def compared(one: dict, two: dict, same: bool) -> pa.RecordBatch:
        counts = [np.zeros(len(one["nodes"]), np.int64), np.zeros(len(two["nodes"]), np.int64)]
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in links(one, two, same):
            np.add.at(counts[0], i, two["copies"][j])
            np.add.at(counts[1], j, one["copies"][i])
            u, v = forest(np.concatenate([u, one["nodes"][i]]), np.concatenate([v, two["nodes"][j]]))
        node = np.concatenate([one["nodes"], two["nodes"], u])
        count = np.concatenate([*counts, np.zeros(len(u), np.int64)])
        other = np.concatenate([one["nodes"], two["nodes"], v])
        keep = (count > 0) | (node != other)
        return pa.RecordBatch.from_pydict({"u": node[keep], "v": other[keep], "n": count[keep]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, tile, pairs, ...) sorted by square: first its pairs without a tile, then its tiles."""
        square, pairs, tiles = None, [], {}
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if (r["a"], r["b"]) != square:
                    square, pairs, tiles = (r["a"], r["b"]), [], {}
                if r["tile"] is None:
                    pairs += [(x["i"], x["j"]) for x in r["pairs"]]
                    continue
                tiles[r["tile"]] = opened(r)
                for i, j in pairs:  # each as soon as both of its tiles are here
                    if r["tile"] in (i, j) and i in tiles and j in tiles:
                        out = compared(tiles[i], tiles[j], i == j)
                        if out.num_rows:
                            yield out

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row, as the module says."""
    ready(rows.sparkSession)
    kind = np.float32 if rows.schema[vector_col].dataType.elementType == FloatType() else np.float64
    item = "float" if kind is np.float32 else "double"
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{item}>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    plain = F.transform("e", lambda x: F.when(x == 0, F.lit(0.0).cast(item)).otherwise(x))  # no negative zeros
    rows = rows.withColumn("e", F.when(finite & F.exists("e", lambda x: x != 0), plain))
    sizes = [r["size"] for r in rows.where("e is not null").groupBy(F.size("e").alias("size")).count().where("count > 1").orderBy("size").collect()]
    known = [_of_one_length(rows.where(F.size("e") == size), size, kind, threshold, tile) for size in sizes]
    if not known:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    known = functools.reduce(DataFrame.unionAll, known)
    out = rows.join(known, "e", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _of_one_length(rows: DataFrame, size: int, kind: type, threshold: float, tile: int) -> DataFrame:
    """(e, n_links, component_id) of each different vector of rows (vec_id, e), all of one length."""
    item = "float" if kind is np.float32 else "double"
    tile = max(16, min(tile, VALUES // size))
    # A group of equal vectors is one node, named by its smallest id, or by a hash if it has none.
    groups = rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    groups = cut(groups.select(F.coalesce("id", F.xxhash64("e")).alias("node"), "id", "e", "copies"))
    moments = groups.select("e").mapInArrow(_moments(size), "data binary").repartition(8).mapInArrow(_added, "data binary").collect()
    values, axes = np.linalg.eigh(sum(np.frombuffer(x["data"], np.float64).reshape(size, size) for x in moments))
    axes = np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])

    count = groups.count()
    turned = groups.select("node", "e", "copies").mapInArrow(_placed(axes), f"node long, e array<{item}>, copies long, c1 int, c2 int, c3 int, lead double")
    order = ["c1", "c2", "c3", "lead", "node"]
    tiles = turned.repartitionByRange(max(1, count // (2 * tile)), *order).sortWithinPartitions(*order)
    tiles = cut(tiles.mapInArrow(_packed(tile, axes), "tile long, low array<double>, high array<double>, nodes binary, copies binary, raw binary"))

    # Two unit vectors with this cosine are at most ``reach`` apart, so tiles meet in a bucket of that
    # width along the first axis; of the tiles that do, those with boxes farther apart hold no link.
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    bucket = lambda x, more: F.floor(F.get(x, F.lit(0)) / reach) + more
    one = tiles.select(F.col("tile").alias("i"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.sequence(bucket("low", -1), bucket("high", 1))).alias("bucket"))
    two = tiles.select(F.col("tile").alias("j"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.explode(F.sequence(bucket("low", 0), bucket("high", 0))).alias("bucket"))
    gap = F.aggregate(F.sequence(F.lit(0), F.size("l1") - 1), F.lit(0.0), lambda a, k: a + F.pow(F.greatest(F.lit(0.0), F.get("l2", k) - F.get("h1", k), F.get("l1", k) - F.get("h2", k)), F.lit(2.0)))
    near = one.join(two, "bucket").where("i <= j").where(F.col("bucket") == F.greatest(bucket("l1", -1), bucket("l2", 0))).where(gap <= reach * reach).select("i", "j")
    square = lambda x: F.expr(f"(({x} >> 32) << 32) + int({x} & 4294967295) div {SIDE}")
    near = cut(near.withColumn("a", square("i")).withColumn("b", square("j")))
    pairs = near.groupBy("a", "b").agg(F.collect_list(F.struct("i", "j")).alias("pairs")).select("a", "b", F.lit(None).cast("long").alias("tile"), "pairs")  # at most SIDE squared
    sent = near.select("a", "b", F.explode(F.array("i", "j")).alias("tile")).distinct().join(tiles, "tile").select("a", "b", "tile", "nodes", "copies", "raw")
    sent = pairs.unionByName(sent, allowMissingColumns=True).repartition(max(1, min(count // 1024, 4096)), "a", "b").sortWithinPartitions("a", "b", "tile")
    links = cut(sent.mapInArrow(_compared(threshold, size, kind, axes), "u long, v long, n long"))

    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    found = components(links.where("u != v").select("u", "v"))
    known = groups.join(counts, "node", "left").join(found, "node", "left").select("id", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    return known.join(known.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("e", "n_links", "component_id")
