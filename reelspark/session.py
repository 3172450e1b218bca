"""Session helpers: worker import path, checkpoint folder, table access."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Unless the session says otherwise.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure a checkpoint folder is set.

    The folder is the one named in ``spark.checkpoint.dir``; only a local session without one (a
    test) gets a temporary folder. Batches for Python are bounded in bytes, since texts can be long.
    """
    sc = spark.sparkContext
    known = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelspark-checkpoint-"))
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written copy."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
