"""Lookups, anti-joins and first-wins unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import source_stem


def copied_captions(images: DataFrame, captions: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """``images`` (rel_dir, stem) with the caption of the image they were made from, and a status.

    A missing source is noticed before an output that is already there.
    """
    keyed = images.withColumn("source_stem", source_stem(F.col("stem")))
    texts = captions.select("rel_dir", F.col("stem").alias("source_stem"), "text")
    there = existing.select("rel_dir", "stem").distinct().withColumn("_there", F.lit(True))
    joined = keyed.join(texts, ["rel_dir", "source_stem"], "left").join(there, ["rel_dir", "stem"], "left")
    exists = F.coalesce(F.col("_there"), F.lit(False)) & F.lit(not overwrite)
    status = F.when(F.col("text").isNull(), "skipped_no_source").when(exists, "skipped_existing").otherwise("created")
    return joined.withColumn("status", status).drop("_there")


def not_yet_done(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs without an output row for their key."""
    return inputs.join(outputs.select(*keys).distinct(), list(keys), "left_anti")


def first_of_each(sources: Sequence[DataFrame], key: str = "path", order: str = "row_ord") -> DataFrame:
    """The union of sources without repeats: the first source and row that name a key."""
    rows = None
    for k, df in enumerate(sources):
        part = df.select(key, order).withColumn("src_ord", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min(F.struct("src_ord", order)).alias("_o")).select(key, "_o.src_ord", F.col(f"_o.{order}").alias(order))


def swap_pairs(tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """Labelled tracks with their target; tracks without a label or a target with portraits drop out."""
    return tracks.where("label is not null").join(targets.where("portraits > 0"), "label")


def variants(images: DataFrame, per_image: int, keep_original: bool) -> DataFrame:
    """An output stem for each variant of each image."""
    made = images.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1)))).withColumn("out", F.format_string("%s_aug%03d", "stem", "k")).drop("k")
    return made.unionByName(images.withColumn("out", F.concat("stem", F.lit("_orig")))) if keep_original else made
