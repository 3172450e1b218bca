"""Identities: greedy clustering, gallery matching, centroids, representatives."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import vec
from reelspark.functions.geometry import iou
from reelspark.operators.fold import Fold, ordered_fold
from reelspark.session import cut


class Known:
    """Encodings with labels, in a matrix that grows by doubling."""

    def __init__(self, references: Sequence[tuple[str, Sequence[float]]] = (), metric: str = "euclidean"):
        self.names, self.n, self.rows, self.metric = [], 0, None, metric
        for name, enc in references:
            self.add(name, np.asarray(enc, np.float64))

    def add(self, name, enc: np.ndarray) -> None:
        if self.metric == "cosine":
            enc = enc / (np.linalg.norm(enc) + vec.EPSILON)
        if self.rows is None:
            self.rows = np.empty((16, len(enc)))
        elif self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.n], self.n = enc, self.n + 1
        self.names.append(name)

    def nearest(self, enc: np.ndarray) -> tuple[object, float]:
        """Label and distance of the nearest one; the first wins a tie."""
        if not self.n:
            return None, np.inf
        if self.metric == "cosine":
            d = 1 - self.rows[: self.n] @ (enc / (np.linalg.norm(enc) + vec.EPSILON))
        else:
            d = np.sqrt(((self.rows[: self.n] - enc) ** 2).sum(1))
        k = int(np.argmin(d))
        return self.names[k], float(d[k])


class _Greedy(Fold):
    def __init__(self, tolerance: float, references: Sequence, metric: str, name: Callable[[int], object], first: int, carry: tuple[str, ...]):
        self.known, self.tolerance, self.name, self.next, self.carry = Known(references, metric), tolerance, name, first, carry

    def step(self, row: dict) -> list[dict]:
        enc = np.asarray(row["enc"], np.float64)
        label, d = self.known.nearest(enc)
        if d > self.tolerance:
            label, self.next = self.name(self.next), self.next + 1
            self.known.add(label, enc)
        return [{k: row[k] for k in self.carry} | {"label": label}]


def first_number(references: Sequence[tuple[str, Sequence[float]]]) -> int:
    """One after the largest number of a ``person_N`` among the names."""
    return 1 + max((int(m[1]) for name, _ in references if (m := re.fullmatch(r"person_(\d+)", name))), default=0)


def greedy_persons(faces: DataFrame, tolerance: float, references: Sequence[tuple[str, Sequence[float]]] = (), key: str = "video", arrival: str = "arrival", metric: str = "euclidean") -> DataFrame:
    """(key, arrival, label): in order of arrival, the nearest known label within the tolerance, or a new person.

    Only new persons join the known ones. ``references`` is a small named gallery, all of it known from the start.
    """
    kinds = {c: faces.schema[c].dataType.simpleString() for c in (key, arrival)}
    schema = f"{key} {kinds[key]}, {arrival} {kinds[arrival]}, label string"
    make = lambda: _Greedy(tolerance, references, metric, lambda n: f"person_{n:02d}", first_number(references), (key, arrival))
    return ordered_fold(faces.select(key, arrival, F.col("enc").cast("array<double>").alias("enc")), [key], [arrival], make, schema)


def segment_persons(segments: DataFrame, tolerance: float, key: str = "video", metric: str = "euclidean") -> DataFrame:
    """``segments`` with person_id: 1, 2, ... by their anchors in order of their start."""
    kinds = segments.schema
    carry = tuple(c for c in segments.columns if c != "anchor")
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in carry) + ", label int"
    rows = segments.withColumnRenamed("anchor", "enc")
    out = ordered_fold(rows, [key], ["start_frame"], lambda: _Greedy(tolerance, (), metric, lambda n: n, 1, carry), schema)
    return out.withColumnRenamed("label", "person_id")


def top_per_identity(gallery: DataFrame, most: int, identity: str = "identity", order: str = "path") -> DataFrame:
    """The first ``most`` rows with an encoding of each identity; 0: all."""
    found = gallery.where(F.col("enc").isNotNull())
    if most <= 0:
        return found
    return found.withColumn("_k", F.row_number().over(W.partitionBy(identity).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def largest_face(faces: DataFrame, image: Sequence[str], area: Column, order: str) -> DataFrame:
    """Each image's largest face, the first of equal ones; none if that one has no encoding."""
    rows = faces.withColumn("_area", area)
    best = F.min_by(F.struct(*faces.columns), F.struct(-F.col("_area"), F.col(order)))
    return rows.groupBy(*image).agg(best.alias("_b")).select("_b.*").where(F.col("enc").isNotNull())


def gallery_match(tracks: DataFrame, gallery: DataFrame, default: float, most_gallery: int = 100_000, block: int = 1000) -> DataFrame:
    """``tracks`` (track_id, enc, ...) with the best gallery label and similarity.

    The best similarity starts at 0, so others lose; below its label's threshold the label is null.
    A gallery of at most ``most_gallery`` rows is broadcast. A larger one is parted into blocks; each
    track meets each block in a join on the block's number, with copies of the blocks for parts of
    the tracks, so that no task has all the tracks of a block.
    """
    g = gallery.select("label", F.col("enc").alias("_g"), "threshold", F.col("ord").alias("_ord"))
    size = gallery.count()
    usable = F.col("enc").isNotNull() & (F.col("track_id") != -1)
    sim = lambda x: F.struct((1 - vec.cosine_distance(F.col("enc"), x["_g"])).alias("sim"), (-x["_ord"]).alias("o"), x["label"].alias("label"), x["threshold"].alias("threshold"))
    best = F.array_max(F.filter(F.transform("_all", sim), lambda x: x["sim"] > 0))
    all_ = F.collect_list(F.struct("_ord", "label", "_g", "threshold")).alias("_all")
    if size <= most_gallery:
        joined = tracks.join(F.broadcast(g.groupBy().agg(all_)), how="left").withColumn("_best", F.when(usable, best)).drop("_all")
    else:
        n = -(-size // block)
        tracks = cut(tracks.withColumn("_row", F.monotonically_increasing_id()))
        parts = -(-tracks.count() // 10_000)
        blocks = g.groupBy(F.pmod(F.xxhash64("_ord", "label"), F.lit(n)).alias("_block")).agg(all_).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
        some = tracks.where(usable).select("_row", "enc", F.pmod(F.xxhash64("_row"), F.lit(max(parts, 1))).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_block"))
        found = some.join(blocks, ["_block", "_part"]).select("_row", best.alias("_best")).groupBy("_row").agg(F.max("_best").alias("_best"))
        joined = tracks.join(found, "_row", "left").drop("_row")
    best = F.col("_best")
    out = joined.withColumn("best_sim", F.coalesce(best["sim"], F.lit(0.0)))
    return out.withColumn("best_label", F.when(F.col("best_sim") >= F.coalesce(best["threshold"], F.lit(default)), best["label"])).drop("_best")


def centroids(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): mean encoding scaled to length 1; a zero mean stays."""
    long = rows.select(label, F.posexplode(F.col("enc").cast("array<double>")).alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("x"))
    mean = long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("m"))
    return mean.select(label, F.when(vec.norm(F.col("m")) > 0, vec.scaled(F.col("m"), vec.norm(F.col("m")))).otherwise(F.col("m")).alias("centroid"))


def central_order(rows: DataFrame, label: str = "label", order: str = "face_id") -> DataFrame:
    """``rows`` with rank: by nearness to their label's mean direction, then by det_score, then in order."""
    units = rows.withColumn("_u", vec.unit(F.col("enc")))
    middle = centroids(units.where("_u is not null").select(label, F.col("_u").alias("enc")), label)
    scored = units.join(middle, label, "left").withColumn("centrality", F.when(F.col("centroid").isNull(), None).otherwise(F.coalesce(vec.dot(F.col("_u"), F.col("centroid")), F.lit(-1.0))))
    by = W.partitionBy(label).orderBy(F.desc(F.round("centrality", 12)), F.desc("det_score"), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(by)).drop("_u", "centroid")


def representatives(rows: DataFrame, label: str = "label", order: str = "face_id") -> DataFrame:
    """Each label's first row by centrality, with the centroid of the label in place of its encoding."""
    first = central_order(rows, label, order).where("rank = 1").drop("enc")
    valid = rows.withColumn("enc", vec.unit(F.col("enc"))).where("enc is not null")
    return first.join(centroids(valid, label), label, "left")


def without_eyewear(portraits: DataFrame, label: str = "label", flag: str = "eyewear") -> DataFrame:
    """Portraits without eyewear; all of them where a label would lose its last one."""
    clean = F.max((~F.col(flag)).cast("int")).over(W.partitionBy(label))
    return portraits.withColumn("_clean", clean).where((F.col("_clean") == 0) | ~F.col(flag)).drop("_clean")


def encodings_of_boxes(queries: DataFrame, faces: DataFrame, image: Sequence[str], size: int = 512) -> DataFrame:
    """Adds enc and overlap to each query box: those of the face of its image that overlaps it most, the first of equal ones.

    ``queries``: image keys, q_ord, top, right, bottom, left. ``faces``: image keys, f_ord, box (x1, y1, x2,
    y2), enc. A box without an overlapping face, or one whose face has no encoding, has zeros; images
    without faces have no rows.
    """
    corner = [F.get("box", F.lit(k)).cast("int").cast("double") for k in range(4)]
    both = queries.join(faces.select(*image, "f_ord", F.array(*corner).alias("_box"), F.col("enc").alias("_enc")), list(image))
    overlap = iou([F.col(c).cast("double") for c in ("left", "top", "right", "bottom")], [F.get("_box", F.lit(k)) for k in range(4)])
    best = F.max_by(F.struct("overlap", "_enc"), F.struct("overlap", -F.col("f_ord"))).alias("_best")
    found = both.withColumn("overlap", overlap).groupBy(*queries.columns).agg(best)
    zeros = F.array_repeat(F.lit(0.0), size)
    return found.select(*queries.columns, F.when(F.col("_best.overlap") > 0, F.coalesce("_best._enc", zeros)).otherwise(zeros).alias("enc"), F.col("_best.overlap").alias("overlap"))


def selected_references(scored: DataFrame, least: float, person: str = "person", path: str = "path", folder: str = "folder") -> DataFrame:
    """(person, path, target) of photos good enough to be references: where each goes under its person's folder."""
    good = scored.where(F.col("score") >= least)
    return good.select(person, path, F.concat(folder, F.lit("/ref/"), F.regexp_extract(path, r"([^/]*)$", 1)).alias("target"))
