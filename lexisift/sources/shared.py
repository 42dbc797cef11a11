"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and the session is one process (tests). On a cluster it must be set."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: the executors have no folder that they share")
        where = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
