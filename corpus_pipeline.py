"""A training corpus from ``documents``: quality, line dedup, near-duplicates, source mix, packing.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``.
No stage collects rows; empty tables give empty results, and other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import jaccard, lines, mixing, packing, quality
from reelspark.llm.queries import tokenizer_path
from reelspark.llm.shared import Shelf, small_side
from reelspark.session import cut, table

#: Names of rows or groups that may be broadcast: 8 or 16 bytes each.
BROADCAST_IDS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Repeated rows go or stay together; an empty or null text has the score of the zero vector.
    """
    scored = quality.quality(docs, table(spark, sf_dir, "labels"), keep=list(COLUMNS))
    return scored.where("predicted = 1").select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur; one that has no words left goes.

    Rows of equal id and text lose the same lines; texts without words, null ones too, stay as they are.
    """
    cleaned = lines.dedup_lines(docs.select(*COLUMNS))
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.where((F.col("n_dropped") == 0) | has_words).withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity of 0.8 or more): the smallest id's, a null id last.

    A row is named by its id and text together, so rows that repeat an id are told apart and of equal
    rows one stays. Texts without words are in no group and all stay.
    """
    rows = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row"), *COLUMNS)
    groups = jaccard.jaccard_groups(rows, width=5, percent=80, id_col="row").where("n_shingles > 0")
    groups = cut(groups.groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count("*").alias("times")))
    shared = small_side(groups.groupBy("component_id").count().where("count > 1").select("component_id"), BROADCAST_IDS)
    grouped = cut(groups.join(shared, "component_id").join(rows.select("row", "doc_id").distinct(), "row"))
    kept = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept")).select("component_id", F.col("kept.row").alias("kept"))
    others = small_side(grouped.join(small_side(kept, BROADCAST_IDS), "component_id").where("row != kept").select("row"), BROADCAST_IDS)
    again = small_side(groups.where("times > 1").select("row"), BROADCAST_IDS)
    left = rows.join(others, "row", "left_anti")
    once = left.join(again, "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")
    return left.join(again, "row", "left_anti").select(*COLUMNS).unionAll(once)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them.

    Rows of equal id, source and size are taken equally often; texts without words are drawn like the
    others of their source; a null source is one of its own.
    """
    return mixing.sampled(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences; a repeated row is packed as often as it occurs."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", good_quality), ("line dedup", without_boilerplate), ("n-gram Jaccard join", one_of_each_group), ("mixing sources to target weights", mixed), ("packing", packed)]

#: Model scores, templates and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again."""
    shelf, docs, before = Shelf(spark), table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shelf.keep(docs)
            if before is not None:
                shelf.drop(before)
            before = docs
    return docs
