"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is to be taken ``target / size of the source`` times: its whole copies are
certain, the fraction is an inclusion probability. The flight phase moves the probabilities of three
units at a time along the null space of the two balancing equations (words and documents), until one
of them is 0 or 1, so both totals stay exact. Chunks of a source fly on their own; a chunk leaves at
most two open units, which fly again with those of other chunks, until a source's open units fit
into one chunk. The two units of a source that are then left are landed on the choice whose words
come nearest.

A hot source is many chunks, and no text is moved: the units are (id, source, size) rows. The table of
sources stays distributed too: the driver has sums over it.

Defined results: null or empty texts have size 0 and take nothing; a null source is a source of its
own, the last one; rows with equal id, source and size are one unit and are taken equally often; a
source without words has target 0; other columns are ignored. The choice depends on the rows alone.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.shared import free, small_side
from reelspark.session import cut, ready

WEIGHTS = (5, 2, 1)
LIMIT = 3
CHUNK = 2048
#: Sources whose rows may be broadcast: about 100 bytes each.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
UNITS = "doc_id long, missing boolean, source string, size long, rows long, whole long, p double"


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0: places in order of source by code point, null last. Only a count for each partition comes to the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, total = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], total))
        total += r["count"]
    before = sources.sparkSession.createDataFrame(before, "part long, before long")
    return placed.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place", "part", "before")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Adds target to (source, words): shares by weight, at most ``limit`` times a source's words, the excess shared again.

    Sources stay where they are; each turn sums up what is over its limit, until no more are.
    """
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    known = cut(_ranked(sources).withColumn("weight", weight).withColumn("most", (limit * F.col("words")).cast("double")))
    total, free = known.agg(F.sum(F.col("words").cast("double")), F.sum("weight")).first()
    left, over = total or 0.0, 0
    while True:
        share = F.col("weight") * F.lit(left) / F.lit(free or 1.0)
        n, taken, rest = known.where(share > F.col("most")).agg(F.count("*"), F.sum("most"), F.sum("weight")).first()
        if n == over:
            return known.withColumn("target", F.when(share > F.col("most"), F.col("most")).otherwise(share)).drop("rank", "weight", "most")
        over, left, free = n, total - taken, known.agg(F.sum("weight")).first()[0] - rest
        if free < 0.5:  # all are at their limit
            return known.withColumn("target", F.col("most")).drop("rank", "weight", "most")


def flight(size: Sequence[float], rows: Sequence[float], p: list[float], rng: random.Random) -> list[int]:
    """Move p in place until at most two units are open; returns those. Keeps the sums of rows * p and of rows * size * p."""
    window: list[int] = []
    for new in range(len(p)):
        if not 0 < p[new] < 1:
            continue
        window.append(new)
        if len(window) < 3:
            continue
        i, j, k = window
        w = [rows[x] * size[x] for x in window]
        u = [rows[j] * w[2] - rows[k] * w[1], rows[k] * w[0] - rows[i] * w[2], rows[i] * w[1] - rows[j] * w[0]]
        if not any(u):
            u = [1 / rows[i], -1 / rows[j], 0.0]  # equal sizes: two units suffice
        top = max(map(abs, u))
        u = [x / top for x in u]
        up = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(window, u, strict=True) if d)
        down = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(window, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(window, u, strict=True):
            p[x] += step * d
            p[x] = 0.0 if p[x] < 1e-9 else 1.0 if p[x] > 1 - 1e-9 else p[x]
        window = [x for x in window if 0 < p[x] < 1]
    return window


def _land(size: Sequence[float], rows: Sequence[float], p: list[float], left: list[int]) -> None:
    """Set the last units so that their words come nearest to the expected ones."""
    want = sum(size[x] * rows[x] * p[x] for x in left)
    best = min(range(2 ** len(left)), key=lambda b: (abs(sum(size[x] * rows[x] * (b >> k & 1) for k, x in enumerate(left)) - want), b))
    for k, x in enumerate(left):
        p[x] = float(best >> k & 1)


def _flown(last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["missing", "doc_id", "size", "rows"], kind="stable")
        rng = random.Random(zlib.crc32(repr(key).encode()))
        order = list(range(len(group)))
        rng.shuffle(order)
        group = group.iloc[order]
        size, rows, p = group["size"].tolist(), group["rows"].tolist(), group["p"].tolist()
        left = flight(size, rows, p, rng)
        if last:
            _land(size, rows, p, left)
        return group.assign(p=p)[["doc_id", "missing", "source", "size", "rows", "whole", "p"]]

    return run


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, rows, copies, source_size, target) of each unit: rows of equal id, source and size."""
    ready(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))
    units = cut(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("units"))
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    whole = F.least(F.lit(limit).cast("long"), F.floor(ratio + 1e-12))
    p = F.when(whole < limit, F.greatest(F.lit(0.0), ratio - whole)).otherwise(0.0)
    plan = targets(sources, weights, limit).select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target", whole.alias("whole"), F.when(p < 1e-12, 0.0).otherwise(p).alias("p"))
    plan = small_side(plan, BROADCAST_SOURCES)
    of_source = F.col("source").eqNullSafe(F.col("s"))
    units = units.join(plan, of_source).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "source", "size", "rows", "whole", "p")

    columns = ["doc_id", "missing", "source", "size", "rows", "whole", "p"]
    settled, open_, level = [units.where("p = 0")], units.where("p > 0"), 0
    while True:
        parts = open_.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / chunk).alias("parts"))
        most = parts.agg(F.max("parts")).first()[0]
        if most is None:
            break
        part = F.pmod(F.xxhash64("doc_id", "missing", "size", F.lit(level)), "parts")
        flown = cut(open_.join(small_side(parts, BROADCAST_SOURCES), of_source).withColumn("part", part).drop("s", "parts").groupBy("source", "part").applyInPandas(_flown(most == 1), UNITS))
        settled.append(flown.where("p = 0 or p = 1"))
        open_ = flown.where("p > 0 and p < 1")
        level += 1
        if most == 1:
            break
    out = settled[0].select(columns)
    for x in settled[1:]:
        out = out.unionAll(x.select(columns))
    out = out.withColumn("copies", F.col("whole") + F.col("p").cast("long"))
    out = out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id")))
    return out.join(plan.select("s", "source_size", "target"), of_source).select("doc_id", "source", "size", "rows", "copies", "source_size", "target")


def size_of(text_col: str = "text"):
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def sampled(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it."""
    key, source, size, copies, words, copy = free(docs, "key", "from", "size", "copies", "words", "copy")
    taken = mix(docs, **kwargs).select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    joined = docs.withColumn(words, size_of("text")).join(taken.hint("shuffle_hash"), on)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*(f"`{c}`" for c in docs.columns))
