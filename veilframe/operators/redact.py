"""Redaction on page text, the completeness guard, and regions on positioned content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.geometry import touches
from veilframe.functions.text import literal_pattern, literal_replacement, whole_value_pattern
from veilframe.rules import BARCODE_FONTS


def hits(pages: DataFrame, targets: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, page_no, value, hits) of every target of a document on each of its pages. whole: only where letters or figures don't go on."""
    pattern = whole_value_pattern if whole else literal_pattern
    both = pages.select("doc_id", "page_no", "text").join(targets.select("doc_id", "value").distinct(), "doc_id")
    return both.select("doc_id", "page_no", "value", F.regexp_count("text", pattern(F.col("value"))).cast("long").alias("hits"))


def redacted(pages: DataFrame, targets: DataFrame, subjects: DataFrame, stamp: bool = True) -> DataFrame:
    """pages (doc_id, page_no, text) with targets (doc_id, value, action) blanked, or replaced by the document's subject id.

    subjects: doc_id, anon_id. Longer values go first, so none leaves a part of another, and a value that is part of a longer figure or word stays there; guard(whole=True) refuses pages that have it only so. With stamp
    the subject id is written below the page. Targets of a document are a few fields, gathered by
    document.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("k"), whole_value_pattern(F.col("value")).alias("p"), "action")))
    t = targets.groupBy("doc_id").agg(order.alias("targets"))
    d = pages.join(t, "doc_id", "left").join(subjects, "doc_id", "left")
    start = F.coalesce(F.col("text"), F.lit(""))
    subject = literal_replacement(F.coalesce("anon_id", F.lit("")))
    text = F.aggregate(F.coalesce("targets", F.array().cast("array<struct<k:int,p:string,action:string>>")), start, lambda a, x: F.regexp_replace(a, x["p"], F.when(x["action"] == "replace", subject).otherwise("")))
    text = F.when(F.col("anon_id").isNotNull() & F.lit(stamp), F.concat(text, F.lit("\nSubject ID: "), "anon_id")).otherwise(text)
    return d.select("doc_id", "page_no", text.alias("text"))


def guard(pages: DataFrame, targets: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, value, missing): targets with no hit on some page, and those pages in order. Any row refuses the document."""
    found = hits(pages, targets, whole)
    return found.groupBy("doc_id", "value").agg(F.array_sort(F.collect_list(F.when(F.col("hits") < 1, F.col("page_no")))).alias("missing")).where(F.size("missing") > 0)


def sum_guard(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """The weaker guard, for comparison: (doc_id, hits, expected, short) by hits in all against targets times pages."""
    g = hits(pages, targets).groupBy("doc_id").agg(F.sum("hits").alias("hits"), F.count("*").alias("expected"))
    return g.withColumn("short", F.col("hits") < F.col("expected"))


def coded_spans(spans: DataFrame, needles: tuple[str, ...] = BARCODE_FONTS) -> DataFrame:
    """Spans whose font's name holds any of the needles, in any case."""
    found = F.lit(False)
    for x in needles:
        found = found | F.lower("font").contains(x.lower())
    return spans.where(found)


def without_regions(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words (doc_id, page_no, x0, y0, x1, y1, ...) that no region (doc_id, page_no, rect) of their page touches."""
    box = F.struct("x0", "y0", "x1", "y1")
    r = regions.where("rect IS NOT NULL").select(F.col("doc_id").alias("__d"), F.col("page_no").alias("__p"), "rect")
    return words.join(r, (F.col("doc_id") == F.col("__d")) & (F.col("page_no") == F.col("__p")) & touches(box, F.col("rect")), "left_anti")


def patterns_blanked(text: Column, *patterns: str, by: str = "") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text
