"""Tag aggregation and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def passing(tags: DataFrame, threshold: float, categories: tuple[int, ...] = (0, 9)) -> DataFrame:
    """Tags at or over the threshold, of the categories that count."""
    return tags.where((F.col("prob") >= threshold) & F.coalesce(F.col("category"), F.lit(0)).isin(*categories))


def readable(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def prefixed(tags: Column, prefix: str | None) -> Column:
    """Names joined by commas, behind a prefix unless it is blank."""
    first = (prefix or "").strip()
    return F.array_join(F.concat(F.array(F.lit(first)), tags) if first else tags, ", ")


def video_captions(tags: DataFrame, threshold: float, prefix: str | None = None, key: str = "video") -> DataFrame:
    """(key, caption): names by mean over the frames where they pass, then by name, both falling."""
    mean = passing(tags, threshold).groupBy(key, readable(F.col("name")).alias("tag")).agg(F.avg("prob").alias("mean"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(F.round("mean", 12), "tag"))))
    return mean.groupBy(key).agg(prefixed(F.transform(ordered, lambda x: x["tag"]), prefix).alias("caption"))


def image_captions(tags: DataFrame, threshold: float, prefix: str | None = None, keys: tuple[str, ...] = ("video", "frame_idx")) -> DataFrame:
    """(keys, caption): names by probability; equal ones general first, then by index."""
    rows = passing(tags, threshold).select(*keys, F.struct((-F.col("prob")).alias("p"), (F.coalesce("category", F.lit(0)) == 9).alias("rating"), "tag_idx", readable(F.col("name")).alias("tag")).alias("t"))
    return rows.groupBy(*keys).agg(prefixed(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["tag"]), prefix).alias("caption"))


def shares(stages: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds percent: a value's part of its group's sum, 0 if that is 0."""
    total = F.sum(value).over(W.partitionBy(*by))
    return stages.withColumn("percent", F.when(total > 0, F.col(value) / total * 100).otherwise(F.lit(0.0)))


def rate(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(F.lit(0.0))
