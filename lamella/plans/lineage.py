"""Cuts the lineage of iterated plans, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamella-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint.

    The result is a plan of its own: what the optimizer knew about the old one
    (its constraints name columns that are gone, its partitioning keeps joins from
    splitting hot keys) is left behind.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
