"""What the operators of this subpackage share: shared-folder tables, words, hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CACHE_WORDS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one under /tmp only where that is unset and the session is local (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = found.get() if found.isDefined() else None
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = f"file:///tmp/veilframe-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(there)
    return there


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/veilframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, records: int = 2000, tasks: int | None = None, sweep: bool = False) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back. Lost executors cost only a reread.

    While it is written, Python workers get at most so many records at once: rows hold whole texts or sets.
    At most so many tasks write: each file of a local or remote store costs more than a few rows do.
    With sweep the shuffle files of the write go as soon as it has ended (from Spark 4.1), not when the
    driver happens to collect its garbage: nothing reads them any more.
    """
    df = df if tasks is None else df.coalesce(tasks)
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_RECORDS)
    swept = spark.conf.get(_SWEEP, None)
    spark.conf.set(_RECORDS, str(min(records, int(before)) if int(before) > 0 else records))
    if sweep:
        spark.conf.set(_SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RECORDS, before)
        if sweep:
            spark.conf.unset(_SWEEP) if swept is None else spark.conf.set(_SWEEP, swept)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:  # all are in one folder; an empty table may have none
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(file)).getParent()
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder; call it once no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/veilframe/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs outside BLANKS, as UTF-8; lower folds A-Z only. bytes.split() parts at exactly these six."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


_KEPT: list[dict] = []


def kept(cache: dict) -> None:
    """Make a worker's cache known, so that another operator's stage in the same worker can drop it."""
    _KEPT.append(cache)


def alone(*own: dict) -> None:
    """Empty all known caches but a stage's own, and give their memory back: one Python worker serves many stages."""
    others = [x for x in _KEPT if x and not any(x is y for y in own)]
    for x in others:
        x.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


class WordHash(dict):
    """64-bit hash of each word, kept while there are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser on 64 bits; wraps around."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values of h; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] + np.uint64(k)
        for j in range(1, k):
            out = mix(out) + h[j : j + n]
    return mix(out)


def components(edges: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """(node, component) of every endpoint of edges (u, v): the least node reachable.

    Large-star and small-star rounds until only stars are left; each round is grouped minima and
    equi-joins over two shuffles, written to the shared folder. Nothing is collected but whether a
    node has a lesser neighbour and others besides.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name, tasks=tasks)
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u").distinct()
        low = sym.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if low.where("m < u AND n > 1").isEmpty():
            break
        large = sym.where("v > u").join(low.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")), name, tasks=tasks)
    e = e.distinct()
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
