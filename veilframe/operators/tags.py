"""Image headers as rows of tags: scrub, uid replacement, comparison, banner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.ids import new_uid
from veilframe.rules import PRIORITY_TAGS, HeaderRules

SUBJECT_TAGS = ("PatientName", "PatientID")
STUDY_UIDS, FILE_UID = ("StudyInstanceUID", "SeriesInstanceUID"), "SOPInstanceUID"


def flattened(tags: DataFrame, cut: int = 400) -> DataFrame:
    """Rows without the pixel group, the value cut as reviews show it; tag as (GGGG,EEEE) from grp and elem."""
    tag = F.format_string("(%04X,%04X)", F.col("grp"), F.col("elem"))
    return tags.where(F.col("grp") != 0x7FE0).select("file", tag.alias("tag"), F.coalesce("keyword", F.lit("")).alias("keyword"), F.left(F.coalesce("value", F.lit("")), F.lit(cut)).alias("value"))


def cleared(keyword: Column, rules: HeaderRules = HeaderRules()) -> Column:
    return ~keyword.isin(*SUBJECT_TAGS) & (keyword.isin(*rules.keywords) | keyword.rlike(rules.pattern))


def scrubbed(tags: DataFrame, subjects: DataFrame, rules: HeaderRules = HeaderRules()) -> DataFrame:
    """tags (file, keyword, value, is_private, ...) with name and id the subject's (where they are there), other identifying values empty at any depth, private tags gone."""
    d = tags.where(~F.col("is_private")).join(subjects.select("file", F.col("anon_id").alias("__id")), "file")
    value = F.when(F.col("keyword").isin(*SUBJECT_TAGS), F.col("__id")).when(cleared(F.col("keyword"), rules), "").otherwise(F.col("value"))
    return d.withColumn("value", value).drop("__id").select(*tags.columns)


def uid_map(tags: DataFrame, subjects: DataFrame, secret: str) -> DataFrame:
    """(anon_id, old_uid, new_uid): one replacement for each study or series uid of a subject."""
    d = tags.where(F.col("keyword").isin(*STUDY_UIDS) & (F.col("value") != "")).join(subjects.select("file", "anon_id"), "file")
    return d.select("anon_id", F.col("value").alias("old_uid")).distinct().withColumn("new_uid", new_uid(secret, F.col("anon_id"), F.col("old_uid")))


def uids_replaced(tags: DataFrame, subjects: DataFrame, secret: str) -> DataFrame:
    """tags with study and series uids by the subject's map, and a file uid of each file's own."""
    d = tags.join(subjects.select("file", F.col("anon_id").alias("__id")), "file")
    m = uid_map(tags, subjects, secret).select(F.col("anon_id").alias("__id"), F.col("old_uid").alias("value"), "new_uid")
    d = d.join(m, ["__id", "value"], "left")
    value = F.when(F.col("keyword").isin(*STUDY_UIDS), F.coalesce("new_uid", "value")).when(F.col("keyword") == FILE_UID, new_uid(secret, F.col("__id"), F.col("value"), F.col("file"))).otherwise(F.col("value"))
    return d.withColumn("value", value).select(*tags.columns)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full comparison of (file, tag, keyword, value) rows: file, tag, keyword, original, anonymized, status."""
    a = before.select("file", "tag", F.col("keyword").alias("ka"), F.col("value").alias("original"), F.lit(True).alias("ina"))
    b = after.select("file", "tag", F.col("keyword").alias("kb"), F.col("value").alias("anonymized"), F.lit(True).alias("inb"))
    status = F.when(F.col("inb").isNull(), "removed").when(F.col("ina").isNull(), "added").when(F.col("original").eqNullSafe(F.col("anonymized")), "unchanged").otherwise("changed")
    return a.join(b, ["file", "tag"], "full_outer").select("file", "tag", F.coalesce("ka", "kb", F.lit("")).alias("keyword"), "original", "anonymized", status.alias("status"))


def review_rank(keyword: Column) -> Column:
    """Place of a keyword in reviews; those not listed share the place after the last."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY_TAGS)), F.coalesce(keyword, F.lit("")))
    return F.when(at == 0, F.lit(len(PRIORITY_TAGS))).otherwise(at - 1).cast("long")


def in_review_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("file", review_rank(F.col("keyword")), F.coalesce(F.nullif("keyword", F.lit("")), "tag"), "tag")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("changed", "removed", "unchanged", "added")))


def banner_zeroed(pixels: Column, y0: Column, rows: Column, cols: Column, samples: Column, frames: Column, size: int = 1) -> Column:
    """Binary pixels, frame after frame, with the first y0 rows of each frame zero; null where y0 is null (no region: refuse)."""
    line = cols * samples * size
    top = F.least(y0, rows) * line
    frame = lambda i: F.substr(pixels, i * rows * line + 1 + top, rows * line - top)
    zeros = F.unhex(F.repeat(F.lit("00"), top))
    parts = F.transform(F.sequence(F.lit(0), F.coalesce(frames, F.lit(1)) - 1), lambda i: F.hex(F.concat(zeros, frame(i))))
    return F.when(y0.isNotNull(), F.unhex(F.array_join(parts, "")))


def banner_zeroed_array(values: Column, y0: Column, width: Column) -> Column:
    """The same for one frame as an array."""
    return F.transform(values, lambda v, i: F.when(i < y0 * width, F.lit(0).cast("float")).otherwise(v))
