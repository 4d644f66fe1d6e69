"""Fingerprints of files, and what has been seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import basename


def fingerprint(content: Column, path: Column | None = None) -> Column:
    """First 16 hex digits of the content's sha256; without content `x` and 15 of the file name's."""
    out = F.substring(F.sha2(content.cast("binary"), 256), 1, 16)
    return out if path is None else F.coalesce(out, F.concat(F.lit("x"), F.substring(F.sha2(basename(path), 256), 1, 15)))


def first_owners(known: DataFrame) -> DataFrame:
    """(fp, owner): the key that had the fingerprint first, from known (key, fp, ordinal)."""
    return known.groupBy("fp").agg(F.min_by("key", F.struct("ordinal", "key")).alias("owner"))


def seen_before(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (key, fp, ...) with `already`: the same key has the fingerprint in known (key, fp, ...)."""
    seen = known.select("key", "fp").distinct().withColumn("already", F.lit(True))
    return files.join(seen, ["key", "fp"], "left").withColumn("already", F.coalesce("already", F.lit(False)))


def conflicts(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files not seen under their own key whose fingerprint another key had first: files' columns and owner."""
    fresh = files.join(known.select("key", "fp").distinct(), ["key", "fp"], "left_anti")
    return fresh.join(first_owners(known), "fp").where("owner <> key")


def verdicts(files: DataFrame, known: DataFrame) -> DataFrame:
    """Per key of files (key, fp, written): total, already, fresh and verdict.

    new: nothing seen before; duplicate: all seen and all outputs there; recreate: all seen, an output
    gone; partial: some seen.
    """
    seen = seen_before(files, known)
    out = seen.groupBy("key").agg(F.count("*").alias("total"), F.count_if("already").alias("already"), F.bool_and("written").alias("there"))
    verdict = F.when(F.col("already") == 0, "new").when(F.col("already") < F.col("total"), "partial").when(F.col("there"), "duplicate").otherwise("recreate")
    return out.select("key", "total", "already", (F.col("total") - F.col("already")).alias("fresh"), verdict.alias("verdict"))


def accumulate(known: DataFrame, new: DataFrame) -> DataFrame:
    """Per key the sorted distinct fingerprints of both (key, fp), joined by spaces, as the mapping stores them."""
    both = known.select("key", "fp").unionByName(new.select("key", "fp")).distinct()
    return both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("fp")), " ").alias("fingerprints"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row of counts from results (success, is_new_id, anon_id, verdict, n_conflicts); zeros for no rows."""
    new = F.coalesce(F.col("is_new_id"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return results.agg(
        F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.coalesce(F.col("success"), F.lit(False))).alias("failed"),
        F.count_if(new).alias("new_ids"), F.count_if(F.col("anon_id").isNotNull() & ~new).alias("reused_ids"),
        F.count_if(F.col("verdict") == "duplicate").alias("skipped_duplicates"), F.count_if(F.col("verdict").isin("partial", "recreate")).alias("partial_repeats"),
        total(F.coalesce("n_conflicts", F.lit(0))).alias("conflicts"),
    )


def conflict_notes(found: DataFrame) -> DataFrame:
    """Per key of found (key, name, owner): count, sorted owners and the first six names, three dots after if there are more."""
    g = found.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("owner")), ", ").alias("owners"), F.array_sort(F.collect_list("name")).alias("names"))
    more = F.when(F.size("names") > 6, ", ...").otherwise("")
    return g.select("key", "n", "owners", F.concat(F.array_join(F.slice("names", 1, 6), ", "), more).alias("names"))


def written_now(plan: DataFrame, listing: DataFrame, start: Column) -> DataFrame:
    """Rows of plan (out, ...) whose output is in listing (path, mtime) and not older than start less a second."""
    recent = listing.where(F.col("mtime") >= start - F.expr("INTERVAL 1 SECOND")).select(F.col("path").alias("out")).distinct()
    return plan.join(recent, "out", "left_semi")
