"""Incremental runs, beyond what bounded runs need: files that arrive go through the same batch functions.

The mapping is the only state that lasts and never expires, so no watermark applies; each micro-batch
reads it, and a batch that is replayed finds its own keys and fingerprints and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from veilframe.operators import fingerprints, mapping

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def arriving(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """New files below root as a stream."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema(FILE_SCHEMA).load(root)


def accumulate(stream: DataFrame, key: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, secret: str) -> StreamingQuery:
    """Start a query that keeps (key, anon_id, fp) of arriving files in the Parquet folder `store`, one sub-folder a batch.

    key(files) gives key, name and fp of each file. A batch's folder is written over when it is run
    again, so each batch counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(store).where(F.col("batch") != number)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise  # only a store that isn't there yet, or has no batch, is an empty one
            have = spark.createDataFrame([], "key string, anon_id string, name string, fp string, batch long")
        files = key(batch)
        known = have.select(F.col("key").alias("original_key"), "anon_id", "name", F.xxhash64("key").alias("ordinal")).distinct()
        subjects = mapping.assign(files.select("key", "name", F.col("fp").alias("first_seen")), known, secret)
        fresh = fingerprints.seen_before(files.select("key", "fp"), have).where("NOT already").select("key", "fp").distinct()
        fresh.join(subjects.select("key", "anon_id", "name"), "key").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
