"""Cutting lineage where a frame is read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> bool:
    """Whether there is a checkpoint folder that all executors share, by spark.checkpoint.dir or as the context has it."""
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def kept(df: DataFrame, sure: bool = False) -> DataFrame:
    """Checkpointed in the shared folder; where none is set, persisted with its lineage.

    sure: its rows must never be worked out anew, so it is checkpointed in any case; without a shared
    folder only a local session may use one of its own.
    """
    spark = df.sparkSession
    if not checkpoint_folder(spark):
        if not sure:
            return df.persist()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file:///tmp/veilframe-{uuid.uuid4().hex}")
    return df.checkpoint()
