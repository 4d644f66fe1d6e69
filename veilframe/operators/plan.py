"""Planned outputs and the lists a reviewer works through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import basename, subject_file_name
from veilframe.rules import SIDE_WORD


def planned(files: DataFrame, root: str) -> DataFrame:
    """files (path, kind, anon_id, side) to src, out, category, anon_id; images keep their side folder."""
    image = F.lower("path").endswith(".dcm")
    name = F.when(image, F.concat_ws("/", F.coalesce("side", F.lit("")), subject_file_name(F.col("anon_id"), F.col("path")))).otherwise(subject_file_name(F.col("anon_id"), F.col("path")))
    category = F.when(image, "image").when(F.col("kind") == "scanned", "scanned form").otherwise("report")
    return files.where("anon_id IS NOT NULL").select(F.col("path").alias("src"), F.concat_ws("/", F.lit(root), "anon_id", name).alias("out"), category.alias("category"), "anon_id")


def flat_name(subject: Column, path: Column) -> Column:
    return F.concat_ws("_", subject, basename(path))


def collisions(plan: DataFrame) -> DataFrame:
    """Outputs that more than one source would be written to."""
    return plan.groupBy("out").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("src")).alias("sources")).where("n > 1")


def staged(files: DataFrame) -> DataFrame:
    """files (path) with rel_path: below a side folder its name stays, all else is flat; clash tells shared names."""
    parts = F.split("path", "/")
    parent = F.element_at(parts, -2)
    rel = F.when((F.size(parts) > 1) & F.lower(parent).contains(SIDE_WORD), F.concat_ws("/", parent, F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))
    return files.withColumn("rel_path", rel).withColumn("clash", F.count("*").over(Window.partitionBy("rel_path")) > 1)


def study_of(files: DataFrame) -> DataFrame:
    """Per package: egfr with any image below it, else kfre."""
    return files.groupBy("package").agg(F.when(F.bool_or(F.lower("path").endswith(".dcm")), "egfr").otherwise("kfre").alias("study"))


def manifest(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    """Pairs (original, output, category) with both sides in listing (path), as review lists: images twice, by pixels and by header."""
    there = listing.select("path").distinct()
    both = pairs.join(there.withColumnRenamed("path", "original"), "original", "left_semi").join(there.withColumnRenamed("path", "output"), "output", "left_semi")
    low = F.lower("original")
    lists = F.when(low.endswith(".dcm"), F.array(F.lit("images"), F.lit("metadata"))).when(low.endswith(".pdf"), F.array(F.lit("reports")))
    return both.select(F.explode(lists).alias("list"), "original", "output", basename("original").alias("label"), basename("output").alias("output_label"), "category")


def review_pages(rows: DataFrame, group: str, order: list[str], size: int = 4) -> DataFrame:
    """rows with position, of_total and page within their group; groups are one subject's review list."""
    w = Window.partitionBy(group)
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("position", n.cast("long")).withColumn("of_total", F.count("*").over(w)).withColumn("page", F.floor((F.col("position") - 1) / size).cast("long"))
