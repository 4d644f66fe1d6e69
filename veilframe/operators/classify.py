"""Document kinds from page text, page images and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import strip
from veilframe.rules import FULL_PAGE_SHARE, SCANNED_CHARS, TemplateRules


def full_page_images(pages: DataFrame, images: DataFrame, share: float = FULL_PAGE_SHARE) -> DataFrame:
    """(doc_id, page_no, full_image): an image covers `share` of the page; never on a page without area."""
    size = images.select("doc_id", "page_no", ((F.col("rect.x1") - F.col("rect.x0")) * (F.col("rect.y1") - F.col("rect.y0"))).alias("a"))
    largest = size.groupBy("doc_id", "page_no").agg(F.max("a").alias("a"))
    page = F.col("width") * F.col("height")
    ok = F.when(page > 0, F.col("a") / page >= share)
    return pages.select("doc_id", "page_no", "width", "height").join(largest, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce(ok, F.lit(False)).alias("full_image"))


def templates(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """(doc_id, template): A, B or unknown by the first two pages' text; A's signs come before B's."""
    first = pages.where("page_no < 2").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "text")))["text"], "\n").alias("t"))
    t = F.concat("t", F.lit("\n"))
    a = t.contains(rules.anchor) | t.rlike(r"(?U)CR No\s*:")
    b = F.lit(False)
    for anchor in rules.anchors_b:
        b = b | t.contains(anchor)
    b = b | (t.contains("Lab No.") & t.rlike(r"(?U)\bName\b") & ~t.contains("CR No"))
    return first.select("doc_id", F.when(a, "A").when(b, "B").otherwise("unknown").alias("template"))


def kinds(docs: DataFrame, pages: DataFrame, study: str = "egfr", rules: TemplateRules = TemplateRules()) -> DataFrame:
    """Per doc_id of docs: total_chars, page_count, kind (scanned, A, B or unknown).

    pages: doc_id, page_no, text, full_image. Scanned: under 20 characters in all, every page an
    image; a document without pages counts as such. The lab study refuses other texts that short.
    """
    sums = pages.groupBy("doc_id").agg(F.sum(F.length(strip("text"))).alias("chars"), F.bool_and("full_image").alias("images"), F.count("*").alias("n"))
    d = docs.select("doc_id").join(sums, "doc_id", "left").join(templates(pages, rules), "doc_id", "left")
    chars, short = F.coalesce("chars", F.lit(0)), F.coalesce("chars", F.lit(0)) < SCANNED_CHARS
    kind = F.when(short & F.coalesce("images", F.lit(True)), "scanned")
    if study == "kfre":
        kind = kind.when(short, "unknown")
    return d.select("doc_id", chars.cast("long").alias("total_chars"), F.coalesce("n", F.lit(0)).cast("long").alias("page_count"), kind.otherwise(F.coalesce("template", F.lit("unknown"))).alias("kind"))
