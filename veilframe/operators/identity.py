"""Whose file is it: identity per package or per group of files, and what must be refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import mapping_key
from veilframe.rules import LAB_PREFIX


def file_keys(files: DataFrame) -> DataFrame:
    """files (path, kind, cr_no, lab_no, name, ...) with key and refusal: unknown template, or no identity in it."""
    value = F.when(F.col("kind") == "A", F.col("cr_no")).when(F.col("kind") == "B", F.col("lab_no"))
    refusal = F.when(F.col("kind") == "unknown", "unknown template").when(F.col("kind").isin("A", "B") & value.isNull(), "no identity")
    return files.withColumn("key", mapping_key(F.col("kind"), value, LAB_PREFIX)).withColumn("refusal", refusal)


def groups(files: DataFrame) -> DataFrame:
    """Files with a key by key, in order of first sight: key, first_path, name (the first not empty), n_files."""
    named = F.when(F.col("name") != "", F.col("path"))
    return files.where("key IS NOT NULL").groupBy("key").agg(F.min("path").alias("first_path"), F.min_by("name", named).alias("name"), F.count("*").alias("n_files"))


def packages(files: DataFrame) -> DataFrame:
    """Per package: n_keys, key, name, n_names, status (ok, conflict, no identity).

    Both templates' keys count together, so reports of two persons conflict whichever their template.
    Of several names for one key the least is taken and n_names tells.
    """
    g = files.groupBy("package").agg(F.count_distinct("key").alias("n_keys"), F.min("key").alias("key"), F.min("name").alias("name"), F.count_distinct("name").alias("n_names"))
    status = F.when(F.col("n_keys") > 1, "conflict").when(F.col("n_keys") == 0, "no identity").otherwise("ok")
    return g.select("package", "n_keys", F.when(status == "ok", F.col("key")).alias("key"), F.when(status == "ok", F.col("name")).alias("name"), "n_names", status.alias("status"))


def several(files: DataFrame, shown: int = 6) -> DataFrame:
    """Packages of more than one key: package, n_keys, keys (sorted), folders (the first six, dots after if there are more)."""
    g = files.groupBy("package").agg(F.array_sort(F.collect_set("key")).alias("k"), F.array_sort(F.collect_set("folder")).alias("f")).where(F.size("k") > 1)
    more = F.when(F.size("f") > shown, ", ...").otherwise("")
    return g.select("package", F.size("k").cast("long").alias("n_keys"), F.array_join("k", ", ").alias("keys"), F.concat(F.array_join(F.slice("f", 1, shown), ", "), more).alias("folders"))


def outcomes(results: DataFrame) -> DataFrame:
    """results (package, anon_id, failed, errors arrays) with status: OK with an id and neither, else NEEDS REVIEW."""
    ok = F.col("anon_id").isNotNull() & (F.size("failed") == 0) & (F.size("errors") == 0)
    return results.withColumn("status", F.when(ok, "OK").otherwise("NEEDS REVIEW"))
