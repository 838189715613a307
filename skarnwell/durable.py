"""Intermediate results that survive the loss of executors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what spark.checkpoint.dir names, else (a local session) a temporary one, set here."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skarnwell-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and cut off from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *made: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the functions return, called two at a time, so that the jobs of one fill the cores that another leaves idle."""
    with ThreadPoolExecutor(2) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f)) for f in made]]
