"""All queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelspark.plans import catalogs, identity, scores, texts, timeline, tracks

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (timeline, identity, tracks, scores, catalogs, texts)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
