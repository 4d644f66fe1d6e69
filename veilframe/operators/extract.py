"""Fields from running text (label, colon, value) and from positioned words (rows and bands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import collapse, is_placeholder, none_if_empty
from veilframe.rules import LABEL_BAND, LABELS_B, PLACEHOLDERS, ROW_TOLERANCE, VALUE_BAND, TemplateRules


def labelled_value(text: Column, label: str, rules: TemplateRules = TemplateRules()) -> Column:
    """What follows the label's first colon up to the next label or section at a line start; null if that is empty.

    Blanks after the colon are not eaten before the end is looked for, so an empty field does not
    take the next label for its value.
    """
    pattern = rf"(?sU)(?:{label})\s*:(.*?)(?:\n\s*(?:{'|'.join(rules.labels)})\s*:|\n\s*(?:{'|'.join(rules.sections)})|\z)"
    return none_if_empty(collapse(F.regexp_extract(text, pattern, 1)))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): page texts in order, joined by line feeds."""
    return pages.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "text")))["text"], "\n").alias("text"))


def fields_a(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """Per doc_id the running-text template's fields; the combined ward label comes before the plain one."""
    d = document_text(pages).select("doc_id", *(labelled_value(F.col("text"), label, rules).alias(name) for name, label in rules.fields))
    label = F.when(F.col("ward_opd").isNotNull(), "Ward/OPD").when(F.col("ward").isNotNull(), "Ward")
    return d.select("doc_id", "cr_no", "patient_name", label.alias("ward_label"), F.coalesce("ward_opd", "ward").alias("ward_value"), "room_bed", "lab_study_no", "validated_by", "clinician")


def targets_a(fields: DataFrame) -> DataFrame:
    """(doc_id, value, action): the identity is replaced, other values are blanked, placeholders left."""
    blank = ("patient_name", "ward_value", "room_bed", "lab_study_no", "validated_by")
    action = [F.struct(F.col(c).alias("value"), F.lit("blank").alias("action")) for c in blank]
    action.append(F.struct(F.when(~is_placeholder(F.col("clinician"), PLACEHOLDERS), F.col("clinician")).alias("value"), F.lit("blank").alias("action")))
    action.append(F.struct(F.col("cr_no").alias("value"), F.lit("replace").alias("action")))
    return fields.select("doc_id", F.explode(F.array(*action)).alias("t")).select("doc_id", "t.value", "t.action").where("value IS NOT NULL AND value <> ''")


def targets_b(fields: DataFrame) -> DataFrame:
    """As targets_a for the positioned template (name, lab_no, ref_by)."""
    t = F.array(*(F.struct(F.col(c).alias("value"), F.lit(a).alias("action")) for c, a in (("name", "blank"), ("ref_by", "blank"), ("lab_no", "replace"))))
    return fields.select("doc_id", F.explode(t).alias("t")).select("doc_id", "t.value", "t.action").where("value IS NOT NULL AND value <> ''")


def row_numbers(sorted_y: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """For an ascending array of y its row numbers: a word stays in a row while within tolerance of the row's first word."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, y: Column) -> Column:
        new = a["first"].isNull() | (F.abs(y - a["first"]) > tolerance)
        row = a["row"] + new.cast("int")
        return F.struct(F.when(new, y).otherwise(a["first"]).alias("first"), row.alias("row"), F.concat(a["rows"], F.array(row)).alias("rows"))

    return F.aggregate(sorted_y, start, step, lambda a: a["rows"])


def word_rows(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """words (doc_id, page_no, n, x0, y0, word) with their row_no, page by page."""
    page = words.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("y0", "n", "x0", "word"))).alias("w"))
    page = page.withColumn("r", row_numbers(F.col("w.y0"), tolerance))
    z = page.select("doc_id", "page_no", F.explode(F.arrays_zip("w", "r")).alias("z"))
    return z.select("doc_id", "page_no", "z.w.n", "z.w.x0", "z.w.y0", "z.w.word", F.col("z.r").alias("row_no"))


def band_text(low: float, high: float) -> Column:
    """Aggregate: a row's words in the band from left to right, colons left out, joined by spaces."""
    inside = (F.col("x0") >= low) & (F.col("x0") < high) & (F.col("word") != ":")
    return F.array_join(F.array_sort(F.collect_list(F.when(inside, F.struct("x0", "y0", "n", "word"))))["word"], " ")


def fields_b(words: DataFrame) -> DataFrame:
    """Per doc_id name, lab_no and ref_by of the first page; of rows with one label the last counts, even when empty."""
    rows = word_rows(words.where("page_no = 0")).groupBy("doc_id", "row_no").agg(band_text(*LABEL_BAND).alias("label"), none_if_empty(band_text(*VALUE_BAND)).alias("value"))
    last = [F.max_by(F.struct("value"), F.when(F.col("label") == text, F.col("row_no")))["value"] for _, text in LABELS_B]
    return rows.groupBy("doc_id").agg(*(c.alias(name) for c, (name, _) in zip(last, LABELS_B)))
